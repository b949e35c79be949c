"""The pipeline's stages against brute force, each on what the one before kept."""

from __future__ import annotations

import math
import random
from collections import Counter

import corpus_pipeline
import pytest
from gridcast.llm import bpe, mixing
from gridcast.llm.registry import RUNS
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(40, 120))), "en", rng.choice(["web", "book", None])))
    for i in range(60, 75):
        rows.append((i, rows[i - 60][1].upper(), "en", "web"))
    for i in range(75, 90):
        rows.append((i, rows[i - 50][1] + " x", "en", "book"))
    odd = [(90, None, "en", "web"), (91, "", None, "web"), (92, "12 34", "en", None), (93, "one", None, None), (None, "without id", "en", "web")]
    return rows + odd


def letters(row):
    return any(c.isalpha() for c in row[1] or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_stages_equal_brute_force(spark, docs_of):
    docs = docs_of(corpus())
    kept = [r for r in corpus() if letters(r)]
    last = {}
    for r in kept:
        last[lowered(r[1])] = max(last.get(lowered(r[1]), -math.inf), -math.inf if r[0] is None else r[0])
    unique = [r for r in kept if (-math.inf if r[0] is None else r[0]) == last[lowered(r[1])]]
    named = plain_components([r[0] for r in unique], [plain_fingerprint(r[1]) for r in unique])
    single = [r for r, name in zip(unique, named, strict=True) if r[0] == name]
    assert len(kept) > len(unique) > len(single)

    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "mixing", "BPE encoding and decoding"]
    for name, expected in (("language ID", kept), ("exact dedup", unique), ("SimHash near-dedup", single)):
        columns = docs.columns
        docs = stages[name](spark, docs, "")
        assert docs.columns == columns
        assert sorted(str(r[:4]) for r in map(tuple, docs.collect())) == sorted(str(r) for r in expected)

    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    mixed = stages["mixing"](spark, docs, "")
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})

    library = Tokenizer.from_file(bpe.word_vocabulary())
    texts = {r[0]: r[1] for r in single}
    rows = stages["BPE encoding and decoding"](spark, mixed, "").collect()
    assert Counter(r.doc_id for r in rows) == Counter({i: n for i, n in copies.items() if n})
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), library.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "same", "en", "a")] * 3])
def test_run_over_small_tables(spark, docs_of, written, rows):
    got = corpus_pipeline.run(spark, written(documents=docs_of(rows))).collect()
    assert {r.doc_id for r in got} <= {1} and bool(got) == any(letters(r) for r in rows)


def test_every_operator_and_the_pipeline_are_registered():
    import __spark_entry__

    runs = __spark_entry__.queries()
    assert set(RUNS) | {"pipeline"} <= set(runs) and len(RUNS) == 13
