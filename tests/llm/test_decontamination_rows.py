"""Decontamination in one slice and in several: rows without an id, repeated ids of documents and items, items without an id."""

import hashlib

import pytest

from locusframe.llm import decontaminate


@pytest.mark.parametrize("slice_chars", [8_000_000, 60])
def test_rows_and_items(spark, slice_chars):
    first, second, third = (" ".join(f"{c}{i}" for i in range(12)) for c in "xyz")
    docs = spark.createDataFrame(
        [(None, f"start {first}", 1), (None, "nothing here", 1), (None, "nothing here", 1), (4, f"{first} and {second}", 1), (4, "more", 2), (5, third, 1), (6, f"a {third} b {first}", 1)],
        "doc_id long, text string, n int",
    )
    bench = spark.createDataFrame([(7, first), (7, second), (None, third), (8, first)], "item_id long, text string")
    found = decontaminate.digest(decontaminate.search(docs, bench, slice_chars=slice_chars, keep=("text", "n")))
    got = sorted(((r["doc_id"], r["text"], r["n"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in found.collect()), key=str)

    def sha(ids):
        return hashlib.sha256(",".join(ids).encode()).hexdigest()

    want = [
        (None, f"start {first}", 1, 13, 12, 2, sha(["7", "8"])), (None, "nothing here", 1, 2, 0, 0, sha([])), (None, "nothing here", 1, 2, 0, 0, sha([])), (4, f"{first} and {second}", 1, 25, 24, 2, sha(["7", "8"])),
        (4, "more", 2, 1, 0, 0, sha([])), (5, third, 1, 12, 12, 1, sha([])), (6, f"a {third} b {first}", 1, 26, 24, 3, sha(["7", "8"])),
    ]
    assert got == sorted(want, key=str)
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == [("4", "more"), ("None", "nothing here"), ("None", "nothing here")]
