from __future__ import annotations

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from gridcast.llm import language_id as g
from gridcast.llm import quality as q
from gridcast.llm.registry import RUNS
from pyspark.sql import functions as F


def prose(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


def corpus(n=160):
    rng = random.Random(7)
    own = {"en": ["th", "er", "ing", "wh", "ou"], "de": ["sch", "ung", "ei", "ö", "ch"], "fr": ["eau", "é", "qu", "oi", "ment"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(own))
        rows.append((i, prose(rng, own[lang], rng.randint(3, 60)), lang))
    return rows


ODD = [(900, None, "en"), (901, "", "de"), (902, "12 34 !?", "fr"), (903, "thering", None), (904, "Ψ", "en"), (905, "Ⅷ ½ 五", None), (None, "schung ei", "de"), (3, "thering whou", "en"), (3, "thering whou", "en")]


def test_language_of_held_out_rows(spark, docs_of, written):
    rows = corpus() + ODD
    got = RUNS["op6_language_id"](spark, written(documents=docs_of(rows).withColumnRenamed("source", "score"))).collect()
    assert len(got) == len(rows)
    langs = {i: (t, lang) for i, t, lang in rows}
    right = [r.lang_pred == langs[r.doc_id][1] for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(right) > 20 and sum(right) / len(right) > 0.95
    for r in got:
        assert r.held_out == (crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 1)
        text = "schung ei" if r.doc_id is None else langs[r.doc_id][0]
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))


def test_prediction_ignores_lang_source_and_id(docs_of):
    rows = corpus(60)
    model = g.train(docs_of(rows))
    one = [(r.text, r.lang_pred, r.score) for r in g.predict(docs_of(rows), model).collect()]
    other = [(r.text, r.lang_pred, r.score) for r in g.predict(docs_of([(9, t, "xx", "y") for _, t, _ in rows]), model).collect()]
    assert sorted(one) == sorted(other)


def test_long_text_is_scored_in_stretches(monkeypatch, docs_of):
    text = corpus(1)[0][1] * 5
    points = g.letter_points(text)
    whole = Counter(np.concatenate(list(g.ngram_buckets(points, 1024))).tolist())
    monkeypatch.setattr(g, "STRETCH", 7)
    assert Counter(np.concatenate(list(g.ngram_buckets(points, 1024))).tolist()) == whole


def test_no_labels_and_empty_table(docs_of):
    assert [r.lang_pred for r in g.identify(docs_of([(1, "text", None)])).collect()] == ["und"]
    assert g.identify(docs_of([])).count() == 0


def test_identified_keeps_rows_and_columns(docs_of):
    docs = docs_of(corpus(30) + ODD)
    kept = g.identified(docs)
    assert kept.columns == docs.columns
    gone = {900, 901, 902}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in corpus(30) + ODD if r[0] not in gone)


# --- quality ---------------------------------------------------------------------------------------


def plain_probability(texts, order=q.ORDER):
    """Interpolated modified Kneser-Ney over signs, written with dictionaries."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = [0] * (order - 2) + q.signs_of(t).tolist()
        for i in range(len(s) - order + 1):
            grams[order][tuple(s[i : i + order])] += 1
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(gram[1:] for gram in grams[k + 1])

    def cuts(k):
        n = Counter(grams[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        return [min(float(c), max(0.0, c - (c + 1) * y * n[c + 1] / n[c])) if n[c] else 0.5 for c in (1, 2, 3)]

    cut = {k: cuts(k) for k in range(1, order + 1)}

    def p(gram):
        if not gram:
            return 1 / q.SIGNS
        k = len(gram)
        seen = {g_: c for g_, c in grams[k].items() if g_[:-1] == gram[:-1]}
        if not seen:
            return p(gram[1:])
        total = sum(seen.values())
        off = lambda c: cut[k][min(c, 3) - 1]
        own = seen.get(gram, 0)
        gamma = sum(off(c) for c in seen.values()) / total
        return (own - off(own) if own else 0) / total + gamma * p(gram[1:])

    return p


def test_probabilities_equal_the_definition(spark, docs_of):
    texts = ["the then there", "that thing", "other", "", None, "ththth the"]
    model = q.train(docs_of(list(enumerate(texts))))
    p = plain_probability(texts)
    asked = ["the", "another thing", "zzz", "é ж 五", "thethe", "", None]
    rows = docs_of(list(enumerate(asked))).withColumn("trusted", F.lit(False))
    got = {r.doc_id: (r.n, r.log_loss) for r in q.score(rows, model).collect()}
    for i, text in enumerate(asked):
        signs = [0] * (q.ORDER - 2) + q.signs_of(text).tolist()
        expected = [math.log(p(tuple(signs[i : i + q.ORDER]))) for i in range(len(signs) - q.ORDER + 1)]
        assert got[i] == (len(expected), pytest.approx(-sum(expected)))


def test_own_ngrams_of_a_trusted_text_count_as_unseen(spark, docs_of):
    docs = docs_of([(1, "the then there"), (2, "that zebra")])
    loss = {r.doc_id: (r.log_loss, r.own_loss) for r in q.score(docs, q.train(docs)).collect()}
    assert all(own > plain for plain, own in loss.values())


def plain_classes(rows, trusted):
    """(doc_id, kept) with the model, leave-one-out, shrinkage and quantiles written with dictionaries and numpy."""
    p = plain_probability([t for d, t, _ in rows if d in trusted])
    grams = Counter()
    for d, t, _ in rows:
        s = [0] * (q.ORDER - 2) + q.signs_of(t).tolist()
        if d in trusted:
            grams.update(tuple(s[i : i + q.ORDER]) for i in range(len(s) - q.ORDER + 1))
    contexts = {g_[:-1] for g_ in grams}
    cut_counts = Counter(grams.values())
    y = cut_counts[1] / (cut_counts[1] + 2 * cut_counts[2]) if cut_counts[1] else 0.0
    cuts = [min(float(c), max(0.0, c - (c + 1) * y * cut_counts[c + 1] / cut_counts[c])) if cut_counts[c] else 0.5 for c in (1, 2, 3)]

    def unseen(gram):
        if gram[:-1] not in contexts:
            return p(gram[1:])
        same = [c for g_, c in grams.items() if g_[:-1] == gram[:-1]]
        return sum(cuts[min(c, 3) - 1] for c in same) / sum(same) * p(gram[1:])

    sums = []
    for d, t, _ in rows:
        s = [0] * (q.ORDER - 2) + q.signs_of(t).tolist()
        own = Counter(tuple(s[i : i + q.ORDER]) for i in range(len(s) - q.ORDER + 1))
        loss = -sum(n * math.log(unseen(g_) if d in trusted and 0 < grams[g_] <= n else p(g_)) for g_, n in own.items())
        sums.append((sum(own.values()), loss))
    good = [i for i, (d, *_) in enumerate(rows) if d in trusted]
    common = sum(sums[i][1] for i in good) / sum(sums[i][0] for i in good)
    steps = [int(math.floor((loss + q.PRIOR_CHARS * common) / (n + q.PRIOR_CHARS) * q.STEPS + 0.5)) for n, loss in sums]
    out = {}
    for i, (d, _, lang) in enumerate(rows):
        own = [steps[j] for j in good if rows[j][2] == lang] or [steps[j] for j in good]
        low, high = (np.percentile(own, 100 * share) for share in (q.LOW, q.HIGH))
        out[d] = math.floor(low - q.MARGIN * q.STEPS) <= steps[i] <= math.ceil(high + q.MARGIN * q.STEPS)
    return out


def test_classes_equal_the_definition(spark, docs_of, monkeypatch):
    monkeypatch.setattr(q, "BATCH_DOCS", 5)
    monkeypatch.setattr(q, "GROUP_BATCHES", 2)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "then", "there", "".join(rng.choices("etaonz", k=4))]) for _ in range(rng.randint(3, 40))), rng.choice(["a", "b", None])) for i in range(30)]
    rows += [(30 + i, "".join(rng.choice("qxzjk") for _ in range(300)), "a") for i in range(3)]
    rows += [(40, "zebra " * 60, "c"), (41, None, "a"), (42, "", "b"), (43, rows[0][1], rows[0][2])]  # a tie at a quantile
    trusted = {*range(0, 20), 43}
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    docs = docs_of(rows).withColumn("n", F.lit("clash")).withColumn("low", F.lit(1)).withColumn("trusted", F.lit(2))
    want = plain_classes(rows, trusted)
    assert {r.doc_id: r.kept for r in q.classify(docs, ids).collect()} == want
    assert len(set(want.values())) == 2
    monkeypatch.setattr(q, "SENT_IDS", 1)  # too many ids to be sent to the texts
    assert {r.doc_id: r.kept for r in q.classify(docs, ids).collect()} == want


def test_quality_keeps_prose_and_drops_noise(spark, docs_of, written):
    rng = random.Random(1)
    rows = corpus(200)
    noise = [(1000 + i, "".join(rng.choices("%&$*#@~^|<>{}xzq0987", k=400)), "en") for i in range(10)]
    loops = [(1100 + i, "wh " * 300, "en") for i in range(3)]
    labels = spark.createDataFrame([(i, 1, 0 if i % 7 else None) for i in range(0, 200, 2)] + [(1000, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    folder = written(documents=docs_of(rows + noise + loops + ODD), labels=labels)
    got = RUNS["op5_kneser_ney_quality"](spark, folder).collect()
    assert len(got) == len(rows + noise + loops + ODD)
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i, *_ in noise + loops)
    assert sum(kept[i] for i, *_ in rows) > 0.95 * len(rows)
    assert all(r.perplexity > 1 and r.low <= r.high for r in got)


def test_quality_without_trusted_or_without_rows(spark, docs_of, written):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    folder = written(documents=docs_of(corpus(5)), labels=none)
    assert all(r.kept for r in RUNS["op5_kneser_ney_quality"](spark, folder).collect())
    assert q.classify(docs_of([]), none.select("doc_id")).count() == 0


def test_long_texts_come_in_stretches(monkeypatch):
    texts = [" ".join(t for _, t, _ in corpus(20)), "the", None]
    whole = q.batch_entries(texts)
    summed = lambda e: Counter({(c, d): 0 for c, d in zip(e["code"].tolist(), e["doc"].tolist())}) + sum(
        (Counter({(c, d): n}) for c, d, n in e.tolist()), Counter()
    )
    monkeypatch.setattr(q, "STRETCH", 50)
    parts = q.batch_entries(texts)
    assert summed(parts[0]) == summed(whole[0]) and (parts[1] == whole[1]).all()
