"""Each stage of the pipeline against a plain version of it, on its own input."""

import random
import re

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from koine.llm.bpe import read_ranks
from koine.llm.queries import RANKS
from tests.llm.test_minhash import brute as near


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, root = random.Random(6), tmp_path_factory.mktemp("sf")
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows, labels = [], []
    for i in range(160):
        words = rng.choices(vocabulary, k=rng.randint(20, 90))
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = "grobnak" + rng.choice("xyz")
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
        labels.append((i, 1, int(i % 4 == 0)))
    for i in range(160, 190):
        base = rows[rng.randrange(160)][1].split(" ")
        if i % 2:
            base[0] = "changed"
        rows.append((i, ("  " if i % 3 else " ").join(base), "en", "s0"))
    rows.append((190, "", "en", None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) as n_chars")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, inputs = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, inputs[-1], folder)
        out.write.parquet(f"{folder}/stage{i}")
        inputs.append(spark.read.parquet(f"{folder}/stage{i}"))
        assert i == 4 or inputs[-1].columns == columns
    rows = [[(r.doc_id, r.text, r.source) for r in df.collect()] for df in inputs[:5]]

    toxic = lambda t: "grobnak" in (t or "")
    assert sorted(x[0] for x in rows[1]) == sorted(x[0] for x in rows[0] if not toxic(x[1]))

    groups = {}
    for d, t, _ in rows[1]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d))
    assert sorted(x[0] for x in rows[2]) == sorted(min(g)[1] for g in groups.values())

    assert sorted(x[0] for x in rows[3]) == [r[0] for r in near([(d, t) for d, t, _ in rows[2]], 5) if r[3]]

    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows[3]}
    copies = {d: sum(x[0] == d for x in rows[4]) for d in sizes}
    assert max(copies.values()) <= 2 and len(rows[4]) == sum(copies.values())
    taken, whole = sum(sizes[d] * n for d, n in copies.items()), sum(sizes.values())
    assert 1.2 * whole < taken < 1.8 * whole

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    texts = {d: t or "" for d, t, _ in rows[4]}
    out = inputs[5].collect()
    assert len(out) == len(rows[4]) and all(r.intact and r.ids == library.encode_ordinary(texts[r.doc_id]) for r in out)

    run = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.n_tokens) for r in run.collect()) == sorted((r.doc_id, r.n_tokens) for r in out)


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
