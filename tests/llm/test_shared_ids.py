"""Operators 7 and 10: texts under one doc_id, null or not, lose only what they share themselves."""

import pytest

from beamquarry.llm import line_dedup, substring_dedup

PASSAGE = [f"p{i}" for i in range(60)]
CLEAN = [f"c{i}" for i in range(90)]


@pytest.mark.parametrize("key", [None, 9])
def test_positions_stay_with_their_text(spark, key):
    rows = [(1, " ".join(PASSAGE)), (key, " ".join([*PASSAGE, "own"])), (key, " ".join(CLEAN))]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["n_words"], r["n_removed"], r["kept_text"]) for r in out if r["doc_id"] == key) == [(61, 60, "own"), (90, 0, " ".join(CLEAN))]
    line = "a line that the first document has"
    rows = [(1, line), (key, f"{line}\nown"), (key, "clean line of another text\nclean")]
    out = line_dedup.aligned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in out if r["doc_id"] == key) == ["clean line of another text\nclean", "own"]
