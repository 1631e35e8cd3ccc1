import os

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from attesta.llm.quality_rules import measure  # noqa: E402
from attesta.llm.queries import PACK_LENGTHS, vocabulary  # noqa: E402
from attesta.llm.shingles import exact_set  # noqa: E402
from attesta.llm.token_counts import TrieCounter, read_ranks  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def survivors(spark):
    """(doc_id -> clean text) of the documents that the first three stages keep, by brute force."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    clean = {k: m[10] for k, t in texts.items() if (m := measure(t.encode(), 30))[6]}
    one = {t: k for k, t in sorted(clean.items())}
    kept = sorted(one.values())
    sets = {k: exact_set(clean[k].encode()) for k in kept}
    label = {k: k for k in kept}
    for a in kept:
        for b in kept:
            if a < b and label[a] != label[b] and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return {k: clean[k] for k in sorted(set(label.values()))}


@pytest.fixture(scope="module")
def sequences(spark):
    return pipeline.run(spark, DATA).toPandas()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are absent")
def test_every_survivor_can_be_rebuilt(survivors, sequences):
    sequences["text"] = sequences["text"].map(bytes)
    rebuilt = sequences.sort_values(["doc_id", "piece"]).groupby("doc_id")["text"].agg(b"".join).to_dict()
    assert rebuilt == {k: t.encode() for k, t in survivors.items() if t}
    trie = TrieCounter(read_ranks(vocabulary()))
    counted = dict(zip(survivors, (n for n, _, _ in trie.count_texts([t.encode() for t in survivors.values()])), strict=True))
    assert sequences.groupby("doc_id")["n_tokens"].sum().to_dict() == {k: n for k, n in counted.items() if n}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are absent")
def test_sequences_are_whole(sequences):
    for _, own in sequences.groupby("bin_id"):
        own = own.sort_values("bin_offset")
        ends = own["bin_offset"] + own["n_tokens"]
        assert own["bin_offset"].tolist() == [0, *ends.tolist()[:-1]]
        used = int(own["n_tokens"].sum())
        assert (own["bin_used"] == used).all() and (own["bin_length"] == min(c for c in PACK_LENGTHS if c >= used)).all()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are absent")
def test_other_weights_change_the_rows(spark, sequences, monkeypatch):
    columns = ["doc_id", "piece", "start", "n_tokens"]
    rows = lambda x, c: sorted(map(tuple, x[c].itertuples(index=False)))
    monkeypatch.setattr(pipeline, "MIX_WEIGHTS", {"src0": 1, "src1": 9, "src2": 1})
    other = pipeline.run(spark, DATA).toPandas()
    assert rows(other, columns) == rows(sequences, columns)  # the same pieces
    assert rows(other, [*columns, "bin_id", "bin_offset"]) != rows(sequences, [*columns, "bin_id", "bin_offset"])  # in other bins
