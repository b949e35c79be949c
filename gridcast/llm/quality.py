"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts characters from the three before them. Trusted documents are counted in tasks,
n-grams are summed by key, and discounts, contexts and lower orders are joined to the counts, all as
sharded aggregations and joins over the whole of the trusted text: the counts grow with it.

Scoring joins counts as well. A batch of documents is turned into (n-gram, document, count) entries,
which go packed to the shards of their n-grams; there they meet the probabilities of the shard and
come back as one partial sum per document. Neither texts nor single n-grams are rows of a shuffle.
The shards are few, since a model has a proven bound; batches are dealt into groups that grow with the
documents, and each group has the shards' probabilities once.
A trusted document is part of what it is scored with: n-grams of full order that it alone holds
count as unseen for it, or else its perplexity, and the quantiles with it, would be too low. Scoring
gives both sums, so that it need not know which documents are trusted.

A character is one of 64 signs: the commonest letters by themselves, all others by a hash. So the
tables of the orders below the highest have a proven bound, 64 ** 3 numbers, whatever the corpus;
they alone are broadcast, for n-grams that trusted text does not hold.

A document is kept when its perplexity lies between two quantiles of the trusted documents of its
language: noise lies above, endless repetition below.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm.common import materialize
from gridcast.llm.registry import register, table

ORDER = 4
SIGN_BITS = 6
SIGNS = 1 << SIGN_BITS
#: Different n-grams of full order there can be.
CODES = SIGNS**ORDER
#: Documents whose counts are packed together, and batches that meet one copy of the probabilities.
BATCH_DOCS = 4096
GROUP_BATCHES = 16
#: Parts of the probabilities: 2 ** 20 n-grams at most in one.
SHARDS = 16
#: Trusted ids up to which texts stay where they are and ids are sent to them (8 bytes each).
SENT_IDS = 1 << 22
#: Quantiles of the trusted documents of a language between which a perplexity is good.
LOW, HIGH = 0.001, 0.999
#: Both are moved outwards by this much of a perplexity: trusted texts look a little too good to lower orders.
MARGIN = 0.05
#: Characters, at the mean of all trusted text, that every document's mean is shrunk with.
PRIOR_CHARS = 200
#: Perplexities are compared at this resolution (steps of the logarithm), which keeps quantiles exact.
STEPS = 1000
STRETCH = 1 << 20
# Fixed value: signs that stand for themselves, after 0 for blanks.
OWN_SIGNS = "etaoinsrhldcumfpgwybvkxjqzéèüöä.,"


@lru_cache(maxsize=1)
def _sign_table() -> np.ndarray:
    """Sign of each code point below 2^16; others are hashed like those above the named ones."""
    points = np.arange(1 << 16, dtype=np.uint64)
    rest = SIGNS - 1 - len(OWN_SIGNS)
    signs = (1 + len(OWN_SIGNS) + ((points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(rest)).astype(np.uint8)
    for i, c in enumerate(OWN_SIGNS):
        signs[ord(c)] = i + 1
    for c in map(chr, range(1 << 16)):
        if c.isspace():
            signs[ord(c)] = 0
    return signs


def signs_of(text: str | None) -> np.ndarray:
    """Signs of the lower-cased text with runs of blanks as one, and a blank before it."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    signs = _sign_table()[points & 0xFFFF]
    signs = np.concatenate((np.zeros(1, np.uint8), signs))
    kept = np.concatenate(([True], (signs[1:] != 0) | (signs[:-1] != 0)))
    return signs[kept]


def codes_of(signs: np.ndarray, order: int) -> np.ndarray:
    """One number per predicted sign: it and the order - 1 signs before it. Blanks stand before a text."""
    padded = np.concatenate((np.zeros(order - 2, np.uint8), signs)).astype(np.int64) if order > 1 else signs[1:].astype(np.int64)
    code = np.zeros(max(0, len(padded) - order + 1), np.int64)
    for k in range(order):
        code = code << SIGN_BITS | padded[k : k + len(code)]
    return code


def count(texts: DataFrame) -> DataFrame:
    """(code, c) over all n-grams of full order in the column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                signs = signs_of(text.as_py())
                for at in range(0, len(signs), STRETCH):
                    part = signs[max(0, at - ORDER + 1) : at + STRETCH]
                    code = codes_of(part, ORDER)
                    code = code[ORDER - 2 :] if at else code  # the first ones belong to the stretch before
                    found, n = np.unique(code, return_counts=True)
                    total[found] += n
        code = np.flatnonzero(total)
        for at in range(0, len(code), 1 << 18):
            part = code[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["code", "c"])

    return texts.select("text").mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Lower:
    """Per order below the highest: log probabilities (NaN where unseen, but for single signs); per context length: log back-off weights."""

    seen: list[np.ndarray]
    backoff: list[np.ndarray]

    def logs(self, code: np.ndarray) -> np.ndarray:
        """Log probabilities of n-grams of full order that trusted text does not hold."""
        out = np.full(len(code), np.nan)
        weight = np.zeros(len(code))
        for order in range(ORDER - 1, 0, -1):
            longer = code & ((1 << SIGN_BITS * (order + 1)) - 1)
            weight += self.backoff[order - 1][longer >> SIGN_BITS]
            found = self.seen[order - 1][code & ((1 << SIGN_BITS * order) - 1)]
            new = np.isnan(out) & ~np.isnan(found)
            out[new] = weight[new] + found[new]
        return out


@dataclass(frozen=True)
class Model:
    """The lower orders, and (code, p, c) of the highest as a table: probability and count."""

    lower: Lower
    top: DataFrame


def train(trusted: DataFrame) -> Model:
    """A model of all texts of `trusted`. Without a text every sign is equally likely."""
    mask = lambda order: F.lit((1 << SIGN_BITS * order) - 1)
    counts = {ORDER: materialize(count(trusted), "ngrams")}
    for order in range(ORDER - 1, 0, -1):
        # Lower orders count the different signs seen before an n-gram, not how often it came.
        lower = counts[order + 1].groupBy(F.col("code").bitwiseAND(mask(order)).alias("code"))
        counts[order] = lower.agg(F.count(F.lit(1)).alias("c"))
    seen, backoff, below = [], [], None
    for order in range(1, ORDER + 1):
        own = counts[order]
        sizes = own.where("c <= 4").groupBy("c").count().collect()  # four rows at most
        n = {r["c"]: r["count"] for r in sizes}
        y = n.get(1, 0) / (n.get(1, 0) + 2 * n.get(2, 0)) if n.get(1) else 0.0
        cuts = [min(float(k), max(0.0, k - (k + 1) * y * n.get(k + 1, 0) / n[k])) if n.get(k) else 0.5 for k in (1, 2, 3)]
        cut = F.when(F.col("c") == 1, cuts[0]).when(F.col("c") == 2, cuts[1]).otherwise(cuts[2])
        context = F.shiftright("code", SIGN_BITS)
        contexts = own.groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.sum(cut).alias("cut"))
        joined = own.withColumn("context", context).join(contexts, "context")
        direct = (F.col("c") - cut) / F.col("total")
        gamma = F.col("cut") / F.col("total")
        if below is None:
            rows = joined.select("code", "c", (direct + gamma / SIGNS).alias("p"))
        else:
            lower = below.select(F.col("code").alias("_lower"), F.col("p").alias("_p"))
            rows = joined.join(lower, F.col("code").bitwiseAND(mask(order - 1)) == F.col("_lower"))
            rows = rows.select("code", "c", (direct + gamma * F.col("_p")).alias("p"))
        below = materialize(rows, "probabilities")
        if order < ORDER:
            found = below.toPandas()  # SIGNS ** order rows at most
            own_logs = np.full(SIGNS**order, np.nan)
            if order == 1:  # signs never seen share what the discounts have left
                rest = contexts.select(gamma.alias("g")).first()
                own_logs[:] = np.log(max(rest["g"], 1e-9) if rest else 1.0) - np.log(SIGNS)
            own_logs[found["code"]] = np.log(found["p"])
            seen.append(own_logs)
        if order > 1:
            weights = np.zeros(SIGNS ** (order - 1))  # an unseen context passes everything on
            found = contexts.select("context", gamma.alias("g")).toPandas()
            weights[found["context"]] = np.log(np.maximum(found["g"], 1e-9))
            backoff.append(weights)
    return Model(Lower(seen, backoff), below)


_ENTRY = np.dtype([("code", "u4"), ("doc", "u2"), ("n", "u4")])
_PROBABILITY, _COUNTS, _DOCUMENTS = range(3)


def _packed(entries: np.ndarray) -> bytes:
    """Field by field, codes and documents as steps, so that little is left to move."""
    steps = np.diff(entries["code"], prepend=np.uint32(0))
    docs = np.diff(entries["doc"], prepend=np.uint16(0))  # modulo 2 ** 16
    return zstandard.compress(steps.tobytes() + docs.view("u1").reshape(-1, 2).T.tobytes() + entries["n"].tobytes(), 1)


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.decompress(body)
    n = len(data) // _ENTRY.itemsize
    code = np.cumsum(np.frombuffer(data, "u4", n), dtype=np.int64)
    halves = np.frombuffer(data, "u1", 2 * n, 4 * n).reshape(2, n)
    doc = np.cumsum(halves[0].astype("u2") | halves[1].astype("u2") << 8, dtype=np.uint16)
    return code, doc, np.frombuffer(data, "u4", n, 6 * n)


def batch_entries(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a batch of texts by code, and the number of signs of each text."""
    keys, counts, sizes = [], [], np.zeros(len(texts), np.int64)
    for doc, text in enumerate(texts):
        signs = signs_of(text)
        sizes[doc] = len(signs) - 1
        for at in range(0, len(signs), STRETCH):
            code = codes_of(signs[max(0, at - ORDER + 1) : at + STRETCH], ORDER)
            code = code[ORDER - 2 :] if at else code  # the first ones belong to the stretch before
            found, n = np.unique(code, return_counts=True)
            keys.append(found << 16 | doc)
            counts.append(n)
    key, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, counts))
    order = np.argsort(key)
    entries = np.zeros(len(key), _ENTRY)
    entries["code"], entries["doc"], entries["n"] = key[order] >> 16, key[order] & 0xFFFF, n[order]
    return entries, sizes


class _Shard:
    """Probabilities and counts of the n-grams of a shard, by code."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], lower: Lower):
        code, p, c = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        order = np.argsort(code)
        self.code, self.log, self.count = np.append(code[order], CODES), np.append(np.log(p[order]), 0.0), np.append(c[order], 0)
        self.lower = lower

    def sums(self, body: bytes, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Per document of a batch the log probability, and what is to be added if the model was trained on it."""
        code, doc, n = _unpacked(body)
        place = np.searchsorted(self.code, code)
        seen = self.code[place] == code
        logs = np.where(seen, self.log[place], 0.0)
        logs[~seen] = self.lower.logs(code[~seen])
        alone = seen & (self.count[place] <= n)
        more = self.lower.logs(code[alone]) - logs[alone]
        return np.bincount(doc, logs * n, docs), np.bincount(doc[alone], more * n[alone], docs)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n (characters scored), log_loss and own_loss (sums of negative log probabilities), one row per row of `docs`.

    `own_loss` holds for a document that the model was trained on. Batches are known by the place of
    their first row: `docs` has to be a written table, whose rows stand in one order whenever it is read.
    """
    lower = docs.sparkSession.sparkContext.broadcast(model.lower)
    groups = -(-docs.count() // (BATCH_DOCS * GROUP_BATCHES)) or 1
    names = ["shard", "part", "kind", "number", "value", "times", "body"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.binary()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(at, BATCH_DOCS)
                number = part.column("row")[0].as_py()
                group = ((number >> 33) + (number & ((1 << 33) - 1)) // BATCH_DOCS) % groups
                entries, sizes = batch_entries(part.column("text").to_pylist())
                shard = entries["code"] % SHARDS
                order = np.argsort(shard, kind="stable")
                entries, ends = entries[order], np.searchsorted(shard[order], np.arange(SHARDS + 1))
                rows = [
                    (k, group, _COUNTS, number, 0.0, len(sizes), _packed(entries[a:b]))
                    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))
                    if b > a
                ]
                own = part.select(["doc_id", "lang"]).append_column("n", pa.array(sizes))
                stream = pa.BufferOutputStream()
                with pa.ipc.new_stream(stream, own.schema) as writer:
                    writer.write_batch(own)
                rows.append((number % SHARDS, group, _DOCUMENTS, number, 0.0, 0, stream.getvalue().to_pybytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by shard, group and kind: the probabilities come before the counts that look them up."""
        current, parts, known = None, [], None
        for batch in batches:
            shard, group, kind, number, value, times = (batch.column(c).to_numpy() for c in names[:-1])
            new = (shard[1:] != shard[:-1]) | (group[1:] != group[:-1]) | (kind[1:] != kind[:-1])
            edges = [0, *(np.flatnonzero(new) + 1), batch.num_rows] if batch.num_rows else [0]
            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if current != (shard[a], group[a]):
                    current, parts, known = (shard[a], group[a]), [], None
                if kind[a] == _PROBABILITY:
                    parts.append((number[a:b], value[a:b], times[a:b]))
                    continue
                bodies = batch.column("body").slice(a, b - a)
                if kind[a] == _DOCUMENTS:
                    out += [(n, _DOCUMENTS, shard[a], body.as_py(), b"") for n, body in zip(number[a:b], bodies, strict=True)]
                    continue
                known = known or _Shard(parts, lower.value)
                parts = []
                for n, size, body in zip(number[a:b], times[a:b], bodies, strict=True):
                    logs, more = known.sums(body.as_py(), size)
                    out.append((n, _COUNTS, shard[a], logs.tobytes(), zstandard.compress(more.tobytes(), 1)))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["number", "kind", "shard", "body", "more"])

    def gather(parts: pd.DataFrame) -> pd.DataFrame:
        """Partial sums of one batch of documents, one per shard."""
        found = pa.ipc.open_stream(parts.loc[parts["kind"] == _DOCUMENTS, "body"].iloc[0]).read_pandas()
        total, own = np.zeros(len(found)), np.zeros(len(found))
        sums = parts.loc[parts["kind"] == _COUNTS].sort_values("shard")
        for body, more in zip(sums["body"], sums["more"], strict=True):
            total -= np.frombuffer(body)
            own -= np.frombuffer(zstandard.decompress(more))
        return found.assign(log_loss=total, own_loss=total + own)

    rows = docs.select("doc_id", "text", "lang").withColumn("row", F.monotonically_increasing_id())
    schema = "shard long, part long, kind long, number long, value double, times long, body binary"
    table = model.top.select(
        (F.col("code") % SHARDS).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"),
        F.lit(_PROBABILITY).cast("long").alias("kind"), F.col("code").alias("number"), F.col("p").alias("value"),
        F.col("c").alias("times"), F.lit(None).cast("binary").alias("body"),
    )
    dealt = rows.mapInArrow(scan, schema).unionByName(table).repartition(SHARDS * groups, "shard", "part")
    sums = dealt.sortWithinPartitions("shard", "part", "kind")
    sums = sums.mapInArrow(join, "number long, kind long, shard long, body binary, more binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return sums.groupBy("number").applyInPandas(gather, f"doc_id {kind}, lang string, n long, log_loss double, own_loss double")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose id is among `ids`: texts stay in place unless the ids are too many to be sent."""
    few = ids.count() <= SENT_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def classify(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, perplexity, low, high, kept.

    `docs` has doc_id, text, lang; `trusted_ids` has doc_id. Perplexity is per character, its
    logarithm shrunk towards that of all trusted text as by `PRIOR_CHARS` characters, so that a text
    without characters, null or empty, has the common one. Null languages are a language of their
    own. A language without trusted documents is judged by the quantiles of all of them; with no
    trusted documents at all everything is kept. No rows give none.
    """
    ids = trusted_ids.select("doc_id").distinct()
    model = train(_only(docs.select("doc_id", "text"), ids))
    scored = score(docs, model).join(ids.withColumn("_trusted", F.lit(True)), "doc_id", "left")
    trusted = F.coalesce("_trusted", F.lit(False))
    loss = F.when(trusted, F.col("own_loss")).otherwise(F.col("log_loss")).alias("log_loss")
    marked = materialize(scored.select("doc_id", "lang", "n", loss, trusted.alias("trusted")), "scored")
    n, loss = marked.where("trusted").agg(F.sum("n"), F.sum("log_loss")).first()
    common = loss / n if n else 0.0
    mean = (F.col("log_loss") + PRIOR_CHARS * common) / (F.col("n") + PRIOR_CHARS)
    marked = marked.withColumn("step", F.round(mean * STEPS).cast("long"))

    good = marked.where("trusted")
    cut = lambda q: F.percentile("step", F.lit(q), F.col("rows"))
    counted = good.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("rows"))  # a few thousand steps per language
    bounds = counted.groupBy("lang").agg(cut(LOW).alias("low"), cut(HIGH).alias("high"))
    bounds = bounds.select(F.col("lang").alias("_lang"), "low", "high")
    everywhere = counted.agg(cut(LOW), cut(HIGH)).first()
    judged = marked.join(bounds, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    low, high = (F.coalesce(c, F.lit(v).cast("double")) for c, v in zip(("low", "high"), everywhere, strict=True))
    low, high = low - MARGIN * STEPS, high + MARGIN * STEPS
    kept = F.coalesce(F.col("step").between(F.floor(low), F.ceil(high)), F.lit(True))
    power = lambda step: F.exp(step / STEPS)
    return judged.select(
        "doc_id", "lang", power(F.col("step")).alias("perplexity"), power(low).alias("low"), power(high).alias("high"), kept.alias("kept")
    )


@register("op5_kneser_ney_quality")
def op5_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    trusted = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    return classify(table(spark, sf_dir, "documents"), trusted)
