from runstrata.operators import retention as R


def test_order_of_rules(spark):
    p = R.Profile("t", exclude_dirs=("build",), exclude_ext=("o",), max_bytes=100, elf_min_bytes=10, exclude_under=((("logs",), ("gz",), 50),), always_keep=("keep/**",), always_exclude=("secret/**",))
    rows = [
        ("secret/keep", 0, 1, b"", "always_exclude"), ("keep/build/a.o", 0, 999, b"", None), ("x/build/a", 1, 1, b"", "exclude_dirs"), ("l.o", 1, 1, b"", None),
        ("a.o", 0, 1, b"", "exclude_ext"), (".o", 0, 1, b"", None), ("big", 0, 101, b"", "max_bytes"), ("logs1/a.gz", 0, 1, b"", "exclude_under.ext"), ("logs1/a", 0, 51, b"", "exclude_under.max_bytes"),
        ("exe", 0, 10, b"\x7fELF", "elf"), ("exe.sh", 0, 10, b"\x7fELF", None), ("small", 0, 9, b"\x7fELF", None), ("build", 0, 1, b"", None),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "path string, kind int, size long, head binary")
    assert {r.path: r.rule for r in R.decide(df, p).collect()} == {r[0]: r[4] for r in rows}


def test_pruned_directory_is_one_row(spark):
    p = R.Profile.resolve("no-build-products")
    df = spark.createDataFrame([("a/target/x", 0, 5), ("a/target/build/y", 0, 7), ("a/z.pyc", 0, 3), ("a/ok", 0, 1)], "path string, kind int, size long")
    assert sorted(map(tuple, R.excluded(R.decide(df, p)).collect())) == [("a/target", 0, "exclude_dirs"), ("a/z.pyc", 3, "exclude_ext")]


def test_deleted(spark):
    df = spark.createDataFrame([("d/a", 0, 5), ("d2/a", 0, 7), ("d", 0, 1)], "path string, kind int, size long")
    gone = spark.createDataFrame([("d",)], "path string")
    assert {r.path: r.rule for r in R.decide(df, R.Profile("none"), gone).collect()} == {"d/a": "deleted", "d": "deleted", "d2/a": None}
