"""Closures of deep and cyclic graphs."""

from parlance.operators.governance import closure


def test_closure_is_deep_and_ends_on_cycles(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("n40", "n38"), ("n0", "n2")]
    got = closure(spark.createDataFrame(chain, "src string, dst string"), spark.createDataFrame([("n0",), ("n39",)], "node string")).collect()
    want = {("n0", "n0"): 0, ("n0", "n1"): 1, **{("n0", f"n{i}"): i - 1 for i in range(2, 41)}, ("n39", "n39"): 0, ("n39", "n40"): 1, ("n39", "n38"): 2}
    assert len(got) == len(want) and {(r["root"], r["node"]): r["depth"] for r in got} == want
