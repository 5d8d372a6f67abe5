import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runstrata.functions import paths as P
from runstrata.operators import namespace

UNIVERSE = ["x", "x/y", "x/y/z", "x-a", "x0", "a", "a/b", "a/b/c", "a-b", "q/r", "q"]


def fold(batches):
    """Batches one after another; a new row removes what conflicts with it."""
    now = {}
    for number, paths in enumerate(batches, 1):
        for p in paths:
            for old in list(now):
                if old == p or old.startswith(p + "/") or p.startswith(old + "/"):
                    del now[old]
            now[p] = number
    return now


def sound(paths):
    """No path of one batch is a directory of another of it."""
    return [p for p in paths if not any(q.startswith(p + "/") for q in paths)]


def rows(spark, batches):
    data = [(p, i, 1 + len(p), f"{p}{i}".encode()) for i, b in enumerate(batches, 1) for p in b]
    df = spark.createDataFrame(data, "path string, batch long, size long, sha binary")
    return df.withColumns({"dir": P.parent(F.col("path")), "name": P.basename(F.col("path"))})


def test_many_random_histories(spark):
    """All histories in one job: each under a prefix of its own."""
    rng, batches, want = random.Random(3), [[] for _ in range(5)], {}
    for k in range(300):
        own = [sound(rng.sample(UNIVERSE, rng.randint(0, 5))) for _ in range(rng.randint(2, 5))]
        for i, b in enumerate(own):
            batches[i] += [f"h{k}/{p}" for p in b]
        want |= {f"h{k}/{p}": n for p, n in fold(own).items()}
    got = {r.path: r.batch for r in namespace.visible(rows(spark, batches)).collect()}
    assert got == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(UNIVERSE), unique=True, max_size=6).map(sound), min_size=2, max_size=4))
def test_last_write_wins(spark, batches):
    assert {r.path: r.batch for r in namespace.visible(rows(spark, batches)).collect()} == fold(batches)


def test_files_become_directories_and_back(spark):
    batches = [["src/lib/one", "src/main", "readme"], ["src/lib", "src/main/a", "src/main/b"], ["src/lib/two", "src/main"], ["docs"]]
    now = namespace.visible(rows(spark, batches))
    assert {r.path: r.batch for r in now.collect()} == {"readme": 1, "src/lib/two": 3, "src/main": 3, "docs": 4}
    root = namespace.rollup(now).where("dir = ''").first()
    assert (root.n_files, root.n_dirs, root.depth) == (4, 1, 0)
    assert [(r.is_dir, r.name) for r in namespace.children(now).collect()] == [(True, "src"), (False, "docs"), (False, "readme")]


def test_a_name_test_does_not_revive(spark):
    now = namespace.visible(rows(spark, [["d/a.txt", "e"], ["d", "e"]]))
    assert namespace.find(now, name="*.txt").count() == 0
    assert namespace.visible(rows(spark, [["b", "c"]]), 1).count() == 2


def test_empty(spark):
    none = rows(spark, [["a"]]).limit(0)
    assert namespace.visible(none).count() == 0 and namespace.rollup(none).count() == 0
    assert tuple(namespace.du(none).first()) == (0, 0, 0, 0)


def test_ancestor_depth_of_intermediate_directories(spark):
    r = {x.dir: (x.n_files, x.n_dirs) for x in namespace.rollup(rows(spark, [["a/b/c/d", "a/x/y"]])).collect()}
    assert r == {"": (2, 1), "a": (2, 2), "a/b": (1, 1), "a/b/c": (1, 0), "a/x": (1, 0)}
