"""The pipeline against a plain version of its stages."""

import math

import corpus_pipeline
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from skyweave.llm import decontamination, queries, toxicity
from tests.llm.test_jaccard import brute
from tests.llm.test_models import plain_features

DATA = "/root/testdata/sf0.001"


def toxic_by_hand(chain, text):
    """The chain walked feature by feature, without the operator's scorer."""
    words = "".join(c.lower() if c < "\x80" else c for c in text or "").split()
    seen, before = plain_features(" ".join(words)), []
    for j in range(len(chain.names)):
        x = sum(n * float(chain.weights[f, j]) for f, n in seen.items()) / max(1, sum(seen.values())) + chain.bias[j]
        x += sum(math.log(p / (1 - p)) * chain.links[i, j] for i, p in enumerate(min(0.99, max(0.01, p)) for p in before))
        before.append(1 / (1 + math.exp(-x)))
    return before[-1] >= 0.5


def test_pipeline(spark):
    docs = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()]
    table = queries.documents(spark, DATA)
    chain = toxicity.fit(table, queries.labels(spark, DATA))
    toxic = {d["doc_id"] for d in docs if toxic_by_hand(chain, d["text"])}
    known = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()}
    assert sum((i in toxic) == bool(t) for i, t in known.items()) >= 0.95 * len(known) and any(known.values())
    rows = [(d["doc_id"], d["text"]) for d in docs if d["doc_id"] not in toxic]
    last = {t or "": i for i, t in sorted(rows)}
    rows = [(i, t) for i, t in rows if last[t or ""] == i]
    rows = [r for r, (i, n, c) in zip(sorted(rows), sorted(brute(rows))) if not n or c == i]
    dirty = {i for i, *_ in decontamination.brute(rows, items)}
    lib = Tokenizer.from_file(queries.vocabulary())
    want = {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in rows if i not in dirty}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
    assert 0 < len(want) < len(docs) - 20


def test_stages_keep_the_columns(spark):
    df = spark.createDataFrame([(None, None, 1, "x"), (5, "", 2, "y"), (5, "", 2, "y"), (6, "a text " * 30, None, None)], "doc_id long, text string, _n int, rk string")
    df = df.withColumns({c: df["_n"] for c in ("key", "row", "first", "fp", "raw", "kept", "toxic", "_id", "n_shingles", "text_sha256", "hash", "_sha", "size")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, DATA).columns == df.columns and stage(spark, df, DATA).count() >= 1
        assert stage(spark, df.limit(0), DATA).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, df, DATA).count() == 4
