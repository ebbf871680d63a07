"""Mixing thousands of sources of a few words each, by the way that many sources take."""

from folio.llm import mixing


def test_small_sources_come_near_their_targets(spark):
    rows = [(k, " ".join(["w"] * (10 + k % 17)), f"s{k:05}") for k in range(5000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 5000 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    off = [abs(r["taken"] - r["target"]) for r in got]
    assert max(off) <= 2 and not any(r["taken"] == 0 for r in got if r["target"] > 2)
    assert abs(sum(r["taken"] for r in got) - 1.5 * sum(r["size"] for r in got)) < 0.01 * sum(r["size"] for r in got)
