"""Benchmark decontamination by template canonicalisation.

Tokens are runs of letters and digits (a number may hold points and commas), A-Z and the Latin-1 capitals lowered.
Numbers, names (capitalised, not where a sentence begins) and units (after a number) become typed placeholders.
Windows of ``window`` template tokens of documents and of benchmark items are hashed and joined by hash; where a
capitalised word begins a sentence, windows with it as a word and as a name are both made. A second set of windows has
the lowered tokens alone, so a copy in other letter case is found as well. A fixed-size
bit table of the items' windows, and up to a size their sorted hashes, spare the join the windows that no item has.

Items of the same tokens are one item, and items of the same template (the same literals and types, with equal values
in the same places) are one in all template windows: a hot template is matched once, under its least item id. Texts
are judged once, however many rows hold them: windows travel under a 128-bit mark of the text.

For each text and item, the joined windows are aligned and the slots are checked: one value in the item must have one
value in the text. An item is in the text, as it stands or with new numbers, names and units, if

* consistent windows with enough literals cover ``share`` of its tokens, or
* windows of its own tokens cover a run of ``run`` in one alignment, or
* windows with too few literals to tell alone (dense in numbers and names) match all together, in one alignment: every
  window of the item that has a literal, and the item has ``told`` literals; or
* it is shorter than ``least`` tokens and stands in the text as it is; below ``alone`` tokens, it must be the whole text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, fresh, frugal, group_bounds, runs
from ._text import ALNUM, U, chunks, mix, utf8, whole, windows, word_hashes, words

#: Fixed: units that may follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l kl gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years hz khz mhz ghz kb mb gb tb w kw mw kwh j kj cal kcal v a mph kmh c f k percent dollars dollar euros euro pounds cents meter meters metre metres kilometer kilometers kilometre kilometres mile miles gram grams kilogram kilograms liter liters litre litres inch inches foot feet degrees".split()


@dataclass(frozen=True)
class Template:
    """Windows of ``window`` tokens; items of fewer are one window. A template window tells by itself with ``literal`` tokens that are no placeholder. The bit table has at most 2**``bits`` places; up to ``exact`` hashes of windows go to the workers as they are. Benchmark windows up to ``broadcast`` rows are broadcast, beyond that the same join is shuffled."""

    window: int = 8
    literal: int = 4
    least: int = 5
    alone: int = 3
    share: float = 0.6
    run: int = 25
    told: int = 3
    bits: int = 22
    exact: int = 1 << 20
    broadcast: int = 200_000


NUM, NAME, UNIT = 1, 2, 3


def canonical(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Surface hash and type (0: literal) of each token, whether it may be a name that begins a sentence, and each text's first token."""
    n = len(buf)
    upper = (buf >= 65) & (buf <= 90)
    low = buf.copy()
    low[upper] += 32
    latin = np.zeros(n, bool)  # the second byte of U+00C0..U+00DE
    if n > 1:
        latin[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    low[latin] += 32
    digit = (buf >= 48) & (buf <= 57)
    member = ALNUM[buf]
    point = np.flatnonzero((buf == 46) | (buf == 44))
    point = point[(point > 0) & (point + 1 < n)]
    point = point[digit[point - 1] & digit[point + 1]]
    shown = low.copy()
    shown[point] = 48  # counts as part of the number; hashed as written below
    starts, ends, first = words(np.where(member, np.uint8(97), np.where(np.isin(np.arange(n), point), np.uint8(97), np.uint8(32))) if len(point) else np.where(member, np.uint8(97), np.uint8(32)), off, ALNUM)
    h = word_hashes(low, starts, ends)
    kind = np.zeros(len(starts), np.int8)
    if not len(starts):
        return h, kind, np.zeros(0, bool), first
    other = np.zeros(n + 1, np.int64)
    ok = digit.copy()
    ok[point] = True
    np.cumsum(~ok, out=other[1:])
    number = other[ends] == other[starts]
    kind[number] = NUM
    unit = np.isin(h, _units())
    unit[1:] &= number[:-1]
    unit[first[:-1][first[:-1] < len(starts)]] = False
    kind[unit & ~number] = UNIT
    # a name: a capital, then a small letter; not certain where a text or a sentence begins
    capital = upper[starts] | ((buf[starts] == 0xC3) & latin[np.minimum(starts + 1, n - 1)])
    size = np.where(buf[starts] == 0xC3, 2, 1)
    second = np.minimum(starts + size, n - 1)
    small = (ends - starts > size) & ~upper[second] & ~latin[np.minimum(second + 1, n - 1)] & member[second]
    solid = np.where(np.isin(buf, np.frombuffer(b" \t\"'([", np.uint8)), -1, np.arange(n))
    before = np.maximum.accumulate(solid)
    prev = np.where(starts > 0, before[np.maximum(starts - 1, 0)], -1)
    inner = np.zeros(len(starts), bool)
    inner[1:] = starts[1:] > 0
    inner[first[:-1][first[:-1] < len(starts)]] = False
    closed = np.isin(buf[np.maximum(prev, 0)], np.frombuffer(b".!?:;|\n\r", np.uint8)) | (prev < 0)
    named, opens = capital & small & (kind == 0), ~inner | closed
    kind[named & ~opens] = NAME
    return h, kind, named & opens, first


_UNIT_HASHES: list[np.ndarray] = []


def _units() -> np.ndarray:
    if not _UNIT_HASHES:
        raw = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
        starts, ends, _ = words(raw, np.array([0, len(raw)]), ALNUM)
        _UNIT_HASHES.append(np.sort(word_hashes(raw, starts, ends)))
    return _UNIT_HASHES[0]


_TYPED = mix(np.arange(1, 4, dtype=U) * U(0x51ED270B))


def _windows(h: np.ndarray, kind: np.ndarray, size: int):
    """Hash and first token of each window of ``size`` tokens."""
    t = np.where(kind > 0, _TYPED[np.maximum(kind - 1, 0)], h)
    return mix(windows(t, size) + U(size))


def _surface(h: np.ndarray, size: int):
    """The same for the tokens themselves; no template has these hashes."""
    return mix(windows(h, size) + (U(size) << U(32)))


def _literals(kind: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(kind == 0, out=total[1:])
    return total[size:] - total[:-size]


#: What a window is: sure template; the tokens themselves; template with sentence beginnings as names; too few literals.
SURE, SURFACE, FREE, POOR = 0, 1, 2, 3

_NAMES = ["hash", "key", "mark", "mark2", "place", "tokens", "slots", "rank", "full", "form"]
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64())
_DDL = "hash long, key long, mark long, mark2 long, place int, tokens int, slots binary, rank int, full int, form long"


def _slots(h, kind, at, size) -> list[bytes]:
    return [np.where(kind[a : a + size] > 0, h[a : a + size], U(0)).tobytes() for a in at]


def _pattern(h: np.ndarray, *kinds: np.ndarray) -> np.ndarray:
    """One value for all items of a template: literals, types, and for each slot the first slot of the same value."""
    parts = []
    for kind in kinds:
        typed = np.flatnonzero(kind)
        _, first, which = np.unique(h[typed], return_index=True, return_inverse=True)
        t = np.where(kind > 0, _TYPED[np.maximum(kind - 1, 0)], h)
        t[typed] ^= first[which].astype(U) * U(0x9E3779B97F4A7C15)
        parts.append(t)
    return np.concatenate(parts)


def _digest(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


@frugal
def _found(batches, p: Template, sizes: list[int] | None, table):
    """Windows of the texts of (key, mark, mark2, text): of items if ``sizes`` is None, else of documents, of those sizes, that the table may hold.

    ``form``: of template windows, the item's template; of surface windows, its tokens. ``full``: how many template windows with a literal the item has.
    """
    for batch in batches:
        keys, marks, marks2 = (batch.column(k).to_pylist() for k in range(3))
        buf, off = utf8(batch.column(3))
        for lo, hi in chunks(off, 1 << 18):
            h, kind, opens, first = canonical(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            rows = []
            n = np.diff(first)
            free = np.where(opens, NAME, kind)
            if sizes is None:
                forms = [(_digest(_pattern(h[a:b], kind[a:b], free[a:b])), _digest(h[a:b])) for a, b in zip(first[:-1], first[1:])]
            full = np.zeros(hi - lo, np.int64)
            for size in sizes if sizes is not None else sorted({min(p.window, int(x)) for x in n if x}):
                if len(h) < size:
                    continue
                keep = np.ones(len(h) - size + 1, bool)
                if sizes is None:
                    for d in range(hi - lo):  # an item has windows of one size
                        if min(p.window, n[d]) != size:
                            keep[first[d] : first[d + 1]] = False
                opened = np.concatenate([[0], np.cumsum(opens)])
                opened = opened[size:] > opened[:-size]
                enough, plain = min(p.literal, size // 2), _literals(kind, size)
                cases = [(SURFACE, kind, _surface(h, size), keep)]
                if size >= p.least:
                    typed, freed = _windows(h, kind, size), _windows(h, free, size)
                    cases += [(SURE, kind, typed, keep & (plain >= enough)), (FREE, free, freed, keep & opened & (_literals(free, size) >= enough)), (POOR, kind, typed, keep & (plain > 0) & (plain < enough))]
                for rank, types, w, some in cases:
                    at = np.flatnonzero(some) if sizes is None else _kept(w, some, *table)
                    doc = np.searchsorted(first, at, "right") - 1
                    inside = at + size <= first[doc + 1]
                    at, doc = at[inside], doc[inside]
                    if sizes is None and rank in (SURE, POOR):
                        full += np.bincount(doc, minlength=hi - lo)
                    slots = [b""] * len(at) if rank == SURFACE and sizes is not None else _slots(h, types, at, size)  # the item's own
                    form = [forms[d][rank == SURFACE] for d in doc] if sizes is None else [0] * len(at)
                    rows += zip(w[at].astype(np.int64).tolist(), [keys[lo + d] for d in doc], [marks[lo + d] for d in doc], [marks2[lo + d] for d in doc], (at - first[doc]).tolist(), n[doc].tolist(), slots, [rank] * len(at), doc.tolist(), form)
            rows = [(*r[:8], int(full[r[8]]), r[9]) for r in rows]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_TYPES), _TYPES)], names=_NAMES)


def _kept(w: np.ndarray, some: np.ndarray, bits: np.ndarray, hashes: np.ndarray | None) -> np.ndarray:
    """Places of windows that the items may have, or have if all their hashes are here."""
    at = np.flatnonzero(some & bits[(w & U(len(bits) - 1)).astype(np.int64)])
    if hashes is None or not len(hashes):
        return at
    own = w[at]
    return at[hashes[np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)] == own]


def consistent(item_places: np.ndarray, shift: np.ndarray, item_slots: list[bytes], doc_slots: list[bytes], tokens: int, rank: np.ndarray | None = None) -> tuple[float, bool, int, int]:
    """Share of an item's tokens under windows whose slots agree, whether all their values are the item's own, the longest run of tokens under surface windows of one alignment, and the most template windows, poor ones included, that agree in one alignment.

    Windows are taken alignment by alignment; within one, the first value met for an item's value holds. Windows of
    lower ``rank`` come first, so the less certain ones only add to what those cover; poor ones cover nothing.
    """
    covered, same, longest, most = np.zeros(tokens, bool), True, 0, 0
    rank = np.zeros(len(shift), np.int64) if rank is None else rank
    order = np.lexsort((item_places, rank, shift))
    for run in np.split(order, np.flatnonzero(np.diff(shift[order])) + 1):
        value: dict[int, int] = {}
        plain, agreed = np.zeros(tokens + 1, bool), set()
        for k in run:
            a, b = np.frombuffer(item_slots[k], U), np.frombuffer(doc_slots[k], U)
            pairs = [(int(a[t]), int(b[t])) for t in np.flatnonzero(a)]
            new: dict[int, int] = {}
            if any(value.get(x, new.setdefault(x, y)) != y for x, y in pairs):
                continue
            value |= {x: y for x, y in pairs}
            at = slice(item_places[k], item_places[k] + len(a))
            if rank[k] in (SURE, POOR):
                agreed.add(int(item_places[k]))
            if rank[k] == POOR:
                continue
            same &= all(x == y for x, y in pairs)
            covered[at] = True
            if rank[k] == SURFACE:
                plain[at] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], plain])))
        longest = max([longest, *(edges[1::2] - edges[::2])])
        most = max(most, len(agreed))
    return float(covered.mean()), same, int(longest), most


@frugal
def _judge(batches, p: Template):
    """Joined windows sorted by (mark, mark2, item_mark, item) -> text and item, where the item is in the text."""
    for table in runs(batches, 1):
        mark, mark2, item = table["mark"].to_numpy(), table["mark2"].to_numpy(), table["item"].to_pylist()
        place, item_place, tokens, text_tokens, full = (table[c].to_numpy() for c in ("place", "item_place", "tokens", "text_tokens", "full"))
        a, b = table["item_slots"].to_pylist(), table["slots"].to_pylist()
        b, rank = [y or x for x, y in zip(a, b)], table["rank"].to_numpy()
        item_no, item_mark = np.array([-1 if x is None else x for x in item], np.int64), table["item_mark"].to_numpy()
        bounds, rows = group_bounds(mark, mark2, item_mark, item_no, np.array([x is None for x in item])), []
        for i, j in zip(bounds[:-1], bounds[1:]):
            n = int(tokens[i])
            if n < p.least:  # found by its only window
                share, same, hit = 1.0, True, n >= p.alone or bool((text_tokens[i:j] == n).any())
            else:
                share, same, longest, most = consistent(item_place[i:j], place[i:j] - item_place[i:j], a[i:j], b[i:j], n, rank[i:j])
                whole = most == int(full[i]) > 0 and len({x for k in range(i, j) if rank[k] in (SURE, POOR) for x in _literal_places(a[k], int(item_place[k]))}) >= p.told
                hit = share >= p.share or longest >= p.run or whole
                same, share = same and share > 0, max(share, float(whole))
            if hit:
                rows.append((int(mark[i]), int(mark2[i]), item[i], share, same))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], names=["mark", "mark2", "item", "share", "same"])


def _literal_places(slots: bytes, at: int) -> np.ndarray:
    """Places of an item's tokens that are no placeholder, under one of its windows."""
    return np.flatnonzero(np.frombuffer(slots, U) == 0) + at


def _marked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("key"), F.xxhash64(text).alias("mark"), F.xxhash64(F.lit(7), text).alias("mark2"), text.alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, p: Template = Template(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs ``mark, mark2, item, share, same``: the two hashes of a text, and the id of an item that is in it (the least id of those items that the rule holds for alike)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    items = _marked(benchmark, item_col, item_text_col).dropDuplicates(["key", "mark", "mark2"])
    windows_ = scratch.put(items.mapInArrow(lambda it: _found(it, p, None, None), _DDL), "items")
    # one item for each form: the others' windows would only say the same again
    form = F.xxhash64("form", F.col("rank") == SURFACE)
    least = windows_.withColumn("f", form).groupBy("f").agg(F.min(F.struct("key", "mark", "mark2")).alias("of"))
    windows_ = windows_.withColumn("f", form).join(least, "f").where(F.struct("key", "mark", "mark2").eqNullSafe(F.col("of"))).drop("f", "of")
    windows_ = scratch.put(windows_, "forms")
    n = windows_.count()
    size = 1 << min(p.bits, max(16, (64 * n).bit_length()))
    places = windows_.select(F.col("hash").bitwiseAND(F.lit(size - 1)).cast("int").alias("x")).distinct().toArrow()["x"].to_numpy()  # at most ``size``
    table = np.zeros(size, bool)
    table[places] = True
    sizes = sorted(int(r[0]) for r in windows_.select(F.least("tokens", F.lit(p.window))).distinct().collect())
    hashes = np.sort(windows_.select("hash").distinct().toArrow()["hash"].to_numpy().view(U)) if n <= p.exact else None
    shared = spark.sparkContext.broadcast((table, hashes))  # at most 2**bits bytes and ``exact`` hashes
    hits = _marked(docs, id_col, text_col).mapInArrow(lambda it: _found(it, p, sizes, shared.value), _DDL)
    # the same window of the same text, from all rows that hold the text, is one
    hits = hits.groupBy("hash", "mark", "mark2", "place", "rank").agg(F.first("slots").alias("slots"), F.first("tokens").alias("text_tokens"))
    mine = windows_.select("hash", F.col("key").alias("item"), F.col("mark").alias("item_mark"), F.col("place").alias("item_place"), "tokens", F.col("slots").alias("item_slots"), F.col("rank").alias("item_rank"), "full")
    joined = hits.join(F.broadcast(mine) if n <= p.broadcast else mine, "hash").select("mark", "mark2", "item_mark", "item", "item_place", "tokens", "text_tokens", "full", "item_slots", "place", "slots", F.greatest("rank", "item_rank").alias("rank"))
    order = ["mark", "mark2", "item_mark", "item"]
    found = joined.repartition("mark", "mark2").sortWithinPartitions(*order).mapInArrow(lambda it: _judge(it, p), "mark long, mark2 long, item long, share double, same boolean")
    return scratch.put(found, "found")


def judge(docs: DataFrame, benchmark: DataFrame, p: Template = Template(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``contaminated``, ``n_items``, ``items`` (sorted ids of the items found; of items with the same tokens or template, the least), ``coverage`` (the largest share) and ``kind`` (verbatim: an item with its own values; template: only with others; else null).

    Null and empty texts hold nothing, except that an empty text is no item either. Rows that repeat an id are judged
    by their own texts; a null id is judged like any other. Items without a token hold no window; items with a null id
    count in ``n_items`` as one more and are not in ``items``. Empty tables give no leak, or no row. Other columns are
    not read.
    """
    found = leaks(docs, benchmark, p, id_col, text_col, item_col, item_text_col)
    by_text = found.groupBy("mark", "mark2").agg((F.count_distinct("item") + F.max(F.col("item").isNull().cast("int"))).cast("long").alias("n_items"), F.sort_array(F.collect_set("item")).alias("items"), F.max("share").alias("coverage"), F.max("same").alias("same"))
    out = _marked(docs, id_col, text_col).select("key", "mark", "mark2").join(by_text, ["mark", "mark2"], "left")
    hit = F.col("n_items").isNotNull()
    return out.select(F.col("key").alias(id_col), hit.alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.when(hit, F.when(F.col("same"), "verbatim").otherwise("template")).alias("kind"))


def clean(docs: DataFrame, benchmark: DataFrame, p: Template = Template(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    names = [fresh(n, docs.columns) for n in ("_leak_mark", "_leak_mark2")]
    found = leaks(docs, benchmark, p, id_col, text_col).select(F.col("mark").alias(names[0]), F.col("mark2").alias(names[1])).distinct()
    text = docs[text_col].cast("string")
    return docs.join(found, (F.xxhash64(text) == found[names[0]]) & (F.xxhash64(F.lit(7), text) == found[names[1]]), "left_anti")
