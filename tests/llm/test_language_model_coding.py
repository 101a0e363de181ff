"""Texts coded by the batch: rows of a text must not depend on the texts beside it, nor on texts without rare words."""

from collections import Counter

import numpy as np
from netaccess.llm import pitman_yor


def test_codes_of_a_batch(spark):
    index = {b"the": 0, b"of": 1}
    known = spark.sparkContext.broadcast((index, np.array([5.0, 2.0])))
    texts = [None, "", "the of the", "rare the Rare odd", " \n", "odd", "of"]
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean").coalesce(1)
    for row in pitman_yor.code_texts(docs, known, 1, 20.0).collect():
        words = (texts[row["doc_id"]] or "").lower().encode().split()
        rare = [w for w in words if w not in index]
        codes = [index[w] if w in index else int(pitman_yor.tail_codes([w])[0]) for w in words]
        assert np.frombuffer(row["codes"], "<i4").tolist() == [*codes, pitman_yor.END]
        assert row["n_tokens"] == len(words) + 1 and row["n_known"] == len(words) - len(rare) + 1
        assert {bytes(x["word"]): x["n"] for x in row["tail"]} == Counter(rare)
