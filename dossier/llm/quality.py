"""Quality classifier by hierarchical empirical Bayes.

Two targets, quality and toxic, are learned from labelled documents by
logistic regression on hashed words, punctuation runs and the document's shape
(repetition, variety, length, share of punctuation): its own evidence.  Only terms that depend on the label beyond chance (``CHI2``) enter.  Grouped aggregation of the labels gives every host and every path
under it a posterior rate: a path shrinks towards its host and a host towards
the global rate, each by a strength estimated from the spread between groups,
so sparse sites stay near the prior.  A document's log odds are its evidence
plus its path's posterior log odds minus the global ones.

All labelled rows fit the regression: its terms come from counts over all of
them, and shards of about ``FIT_ROWS`` rows, dealt by a seeded hash of doc_id, fit
a model each, whose parameters are averaged by rows.  Label rates use all labels,
and every document is scored over its whole text.

Defined results
* null text: no evidence, so the site posterior decides; null host or path: a site of its own
* null labels are ignored; several labels of a document all count in the rates, and the fit takes the greatest of them
* no labels at all: probability 1/2 for both targets and every document is kept
* repeated rows are scored each; an empty table gives an empty table; extra columns stay, whatever their names
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm import textcore
from dossier.llm.durable import durable, fresh, release

TARGETS = ("quality", "toxic")
FIT_ROWS = 12_000
BINS = 1 << 20
CHI2 = 30.0
MOST_TERMS = 4096
#: A document is rejected from this probability of being toxic on; letting one through costs more than losing a clean one.
TOXIC_LIMIT = 0.2
_RARE_SITE = 1e6
#: Site rates are sent to the tasks up to this many sites, a few MB.
MOST_SITES_SENT = 20_000
#: Labels are sent to the tasks up to this many labelled documents, some tens of MB.
MOST_LABELS_SENT = 1_000_000


_STEPS = np.array([0.0, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7])


def _features(data: np.ndarray, offsets: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct bins of the words, punctuation runs and shape, first index per document)."""
    h, bounds = textcore.words(data, offsets)
    mark = ((data >= 33) & (data <= 47)) | ((data >= 58) & (data <= 64)) | ((data >= 91) & (data <= 96)) | ((data >= 123) & (data <= 126))
    masked = np.where(mark, data, np.uint8(32))
    s, e = textcore.word_bounds(masked, offsets)
    p, at = textcore.hash_words(masked, s, e), np.searchsorted(s, offsets)
    letters = np.where(mark, np.uint8(32), data)  # words freed of punctuation
    s, e = textcore.word_bounds(letters, offsets)
    q, to = textcore.hash_words(letters, s, e), np.searchsorted(s, offsets)
    out, first = [], [0]
    marks = np.concatenate([[0], np.cumsum(mark)])
    for i in range(len(offsets) - 1):
        w = h[bounds[i] : bounds[i + 1]]
        m, size = len(w), int(offsets[i + 1] - offsets[i])
        shape = []
        if m:
            kinds = np.unique(w)
            again = np.count_nonzero(w[1:] == w[:-1]) / m
            punct = (marks[offsets[i + 1]] - marks[offsets[i]]) / size
            shape = [
                np.searchsorted(_STEPS, again), 100 + np.searchsorted(_STEPS, 1 - len(kinds) / m) * 8 + min(m.bit_length() // 2, 7),
                200 + np.searchsorted(_STEPS, punct), 300 + min(m.bit_length(), 20), 400 + min(size // m, 30),
            ]
        own = np.concatenate([w, q[to[i] : to[i + 1]], textcore.mix(p[at[i] : at[i + 1]]), textcore.mix(np.array(shape, np.uint64) + np.uint64(1 << 40))])
        bins_here = np.unique((own % np.uint64(bins)).astype(np.int32))
        out.append(bins_here)
        first.append(first[-1] + len(bins_here))
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(first)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return c[first[1:]] - c[first[:-1]]


def choose_terms(feats: np.ndarray, rows: np.ndarray, y: np.ndarray, bins: int) -> np.ndarray:
    """Bins whose presence depends on the label: at most MOST_TERMS, by chi-square."""
    n, pos = len(y), y.sum()
    here = np.bincount(feats, minlength=bins).astype(float)
    with_pos = np.bincount(feats, weights=y[rows], minlength=bins)
    a, b, c, d = with_pos, here - with_pos, pos - with_pos, n - pos - here + with_pos
    chi2 = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
    top = np.argsort(-chi2, kind="stable")[:MOST_TERMS]
    return top[chi2[top] >= CHI2]


def fit_logistic(feats: np.ndarray, first: np.ndarray, y: np.ndarray, bins: int = BINS, epochs: int = 400, l2: float = 1e-5, terms: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights (zero outside the chosen terms, those of ``terms`` where given) and intercept, by AdaGrad on full batches of term presence."""
    rows = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(first))
    terms = choose_terms(feats, rows, y, bins) if terms is None else terms
    place = np.full(bins, -1, np.int32)
    place[terms] = np.arange(len(terms))
    at = place[feats]
    rows, at = rows[at >= 0], at[at >= 0]
    w, g2 = np.zeros(len(terms)), np.full(len(terms), 1e-8)
    rate = min(max(y.mean(), 0.5 / len(y)), 1 - 0.5 / len(y))  # a shard may hold one class only
    b, gb = float(np.log(rate / (1 - rate))), 1e-8
    for _ in range(epochs):
        z = np.bincount(rows, weights=w[at], minlength=len(y)) + b
        d = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.bincount(at, weights=d[rows], minlength=len(terms)) / len(y) + l2 * w
        g2 += grad * grad
        w -= grad / np.sqrt(g2)
        gb += d.mean() ** 2
        b -= 0.1 * float(d.mean() / np.sqrt(gb))
    out = np.zeros(bins)
    out[terms] = w
    return out, b


def _strength(sites: DataFrame, base: dict) -> dict:
    """How far the rates of sites shrink to ``base`` (a column per target), from their spread beyond chance."""
    parts = []
    for t in TARGETS:
        n, k, b = F.col(f"n_{t}"), F.col(f"k_{t}"), base[t]
        off = F.when(n > 0, n * F.pow(k / n - b, 2))
        parts += [F.sum(n).alias(f"n_{t}"), F.sum(off).alias(f"v_{t}"), F.sum(F.when(n > 0, b * (1 - b))).alias(f"e_{t}"), F.sum(n * b * (1 - b)).alias(f"u_{t}")]
    m, out = sites.agg(*parts).first(), {}
    for t in TARGETS:
        n = m[f"n_{t}"] or 0
        between = ((m[f"v_{t}"] or 0.0) - (m[f"e_{t}"] or 0.0)) / n if n else 0.0
        out[t] = min(max(m[f"u_{t}"] / n / between - 1, 1.0), _RARE_SITE) if between > 1e-12 else _RARE_SITE
    return out


def site_rates(labelled: DataFrame) -> tuple[DataFrame, dict]:
    """Durable (host, path, quality_host, quality_path, toxic_host, toxic_path) and the global rates.

    ``labelled``: host, path, quality, toxic.  One pass sums the labels by path;
    hosts, spreads and posteriors come from that table.
    """
    sums = [f(t) for t in TARGETS for f in (lambda t: F.count(t).alias(f"n_{t}"), lambda t: F.sum(F.col(t).cast("double")).alias(f"k_{t}"))]
    paths = durable(labelled.groupBy("host", "path").agg(*sums).na.fill(0.0, [f"k_{t}" for t in TARGETS]), "quality-labels")
    again = [F.sum(c).alias(c) for c in paths.columns[2:]]
    total = paths.agg(*again).first()
    prior = {t: total[f"k_{t}"] / total[f"n_{t}"] if total[f"n_{t}"] else 0.5 for t in TARGETS}
    hosts = paths.groupBy("host").agg(*again)
    of_host = _strength(hosts, {t: F.lit(prior[t]) for t in TARGETS})
    hosts = hosts.select(F.col("host").alias("h"), *[((F.col(f"k_{t}") + of_host[t] * prior[t]) / (F.col(f"n_{t}") + of_host[t])).alias(f"{t}_host") for t in TARGETS])
    under = paths.join(hosts, paths.host.eqNullSafe(hosts.h)).drop("h")
    of_path = _strength(under, {t: F.col(f"{t}_host") for t in TARGETS})
    rate = [((F.col(f"k_{t}") + of_path[t] * F.col(f"{t}_host")) / (F.col(f"n_{t}") + of_path[t])).alias(f"{t}_path") for t in TARGETS]
    out = durable(under.select("host", "path", *[f"{t}_host" for t in TARGETS], *rate), "quality-sites")
    release(paths)
    return out, prior


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _term_chi2(n: int, pos: int, with_pos: str) -> Column:
    """Chi-square of the presence of a term (here rows, ``with_pos`` of them positive) against a target."""
    a, b = F.col(with_pos).cast("double"), (F.col("here") - F.col(with_pos)).cast("double")
    c, d = F.lit(float(pos)) - a, F.lit(float(n - pos)) - b
    return F.lit(float(n)) * F.pow(a * d - b * c, 2) / F.greatest((a + b) * (c + d) * (a + c) * (b + d), F.lit(1e-9))


def _chosen_terms(found: DataFrame, n: int, pos: dict, bins: int) -> dict:
    """Bins by target whose presence depends on the label over all ``found`` rows: at most MOST_TERMS each, by chi-square."""

    def count(batches):
        import pyarrow as pa

        tally = np.zeros((1 + len(TARGETS), bins), np.int32)
        for batch in batches:
            data, offsets = textcore.buffers(batch.column("f"))
            feats, size = data.view(np.int32), np.diff(offsets) // 4
            tally[0] += np.bincount(feats, minlength=bins).astype(np.int32)
            for k, t in enumerate(TARGETS, 1):
                tally[k] += np.bincount(feats[np.repeat(batch.column(t).to_numpy() > 0, size)], minlength=bins).astype(np.int32)
        at = np.flatnonzero(tally[0])
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(x[part].astype(np.int64)) for x in tally)], names=["bin", "here", *TARGETS])

    counts = found.select("f", *TARGETS).mapInArrow(count, "bin long, here long, " + ", ".join(f"{t} long" for t in TARGETS))
    counts = durable(counts.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("here", *TARGETS)]), "quality-terms")  # at most ``bins`` rows
    out = {}
    for t in TARGETS:
        best = counts.select("bin", _term_chi2(n, pos[t], t).alias("chi2")).where(F.col("chi2") >= CHI2)
        out[t] = np.array([r.bin for r in best.orderBy(F.desc("chi2"), "bin").limit(MOST_TERMS).collect()], np.int64)
    release(counts)
    return out


def _fit(docs: DataFrame, labels: DataFrame, fit_rows: int, bins: int):
    chosen = labels.where("quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    if chosen.count() <= MOST_LABELS_SENT:  # else a shuffled join
        chosen = F.broadcast(chosen)
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(chosen, "doc_id")

    def extract(batches):
        import pyarrow as pa

        for batch, i, j, data, offsets in textcore.text_pieces(batches):
            feats, first = _features(data, offsets, bins)
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("quality").cast(pa.int32()), part.column("toxic").cast(pa.int32()), pa.array([feats[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()), part.column("h")],
                names=["doc_id", "quality", "toxic", "f", "h"],
            )

    found = own.mapInArrow(extract, "doc_id long, quality int, toxic int, f binary, h long")
    one = F.min(F.struct("h", "quality", "toxic", "f")).alias("least")  # of the rows of one id
    found = durable(found.groupBy("doc_id").agg(one).select("doc_id", "least.quality", "least.toxic", "least.f"), "quality-fit")
    sums = found.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(t) > 0).alias(t) for t in TARGETS]).first()
    if not sums.n:
        release(found)
        return None
    terms = _chosen_terms(found, sums.n, sums.asDict(), bins)
    shards = -(-sums.n // fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def narrow(batches):
        import pyarrow as pa

        known = np.zeros(bins, bool)
        for t in TARGETS:
            known[shared.value[t]] = True
        for batch in batches:
            data, offsets = textcore.buffers(batch.column("f"))
            feats, first = data.view(np.int32), offsets // 4
            parts = [feats[a:b][known[feats[a:b]]].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("doc_id"), *(batch.column(t) for t in TARGETS), pa.array(parts, pa.binary())], names=["shard", "doc_id", *TARGETS, "f"])

    def fit(rows):
        import pyarrow as pa

        rows = rows.sort_by("doc_id")
        each = [np.frombuffer(x.as_buffer(), np.int32) for x in rows["f"]]
        feats, first = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        out = []
        for t in TARGETS:
            w, b = fit_logistic(feats, first, (rows[t].to_numpy() > 0).astype(float), bins, terms=shared.value[t])
            out += [w[shared.value[t]], [b]]
        return pa.table({"w": pa.array([(np.concatenate(out) * len(each)).tobytes()], pa.binary())})

    dealt = found.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(shards)))
    fitted = durable(dealt.select("shard", "doc_id", *TARGETS, "f").mapInArrow(narrow, "shard long, doc_id long, quality int, toxic int, f binary").groupBy("shard").applyInArrow(fit, "w binary"), "quality-models")
    mean, at, models = textcore.summed(fitted, "w", np.float64, fitted.count()) / sums.n, 0, {}
    for t in TARGETS:
        w, size = np.zeros(bins), len(terms[t])
        w[terms[t]], b = mean[at : at + size], mean[at + size]
        at += size + 1
        if not 0 < sums[t] < sums.n:
            w, b = np.zeros(bins), 4.0 if sums[t] else -4.0
        models[t] = w.astype(np.float32), float(b)
    release(found, fitted)
    shared.unpersist()
    return models


def score_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", fit_rows: int = FIT_ROWS, bins: int = BINS) -> DataFrame:
    """``docs`` plus p_quality, p_toxic and kept."""
    own = [c for c in docs.columns if c not in ("p_quality", "p_toxic", "kept")]
    seen = labels.select("doc_id", "quality", "toxic")
    model = _fit(docs, seen, fit_rows, bins)
    if model is None:
        return docs.select(*own, F.lit(0.5).alias("p_quality"), F.lit(0.5).alias("p_toxic"), F.lit(True).alias("kept"))
    labelled = docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path")).join(seen, "doc_id").select("host", "path", "quality", "toxic")
    table, prior = site_rates(labelled)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    odds_of = {t: min(max(p, 1e-6), 1 - 1e-6) for t, p in prior.items()}
    plain = {t: math.log(p / (1 - p)) for t, p in odds_of.items()}  # without evidence
    evidence_of = dict(zip(TARGETS, fresh(docs, "evidence_quality", "evidence_toxic")))
    schema = docs.select(*own).schema
    for name in evidence_of.values():
        schema = schema.add(name, "double")

    def evidence(batches):
        import pyarrow as pa

        m = shared.value
        for batch, i, j, data, offsets in textcore.text_pieces(batches):
            feats, first = _features(data, offsets, bins)
            some = np.diff(first) > 0
            z = [np.where(some, _sums(m[t][0][feats], first) + m[t][1], plain[t]) for t in TARGETS]
            yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *map(pa.array, z)], names=schema.names)

    scored = docs.select(*own).mapInArrow(evidence, schema)
    h, p, *rates = fresh(scored, "site_host", "site_path", "path_quality", "path_toxic", "host_quality", "host_toxic")
    of_path, of_host = dict(zip(TARGETS, rates[:2])), dict(zip(TARGETS, rates[2:]))
    paths = table.select(F.col("host").alias(h), F.col("path").alias(p), *[F.col(f"{t}_path").alias(of_path[t]) for t in TARGETS])
    hosts = table.groupBy(F.col("host").alias(h)).agg(*[F.first(f"{t}_host").alias(of_host[t]) for t in TARGETS])
    if table.count() <= MOST_SITES_SENT:  # else a shuffled join
        paths, hosts = F.broadcast(paths), F.broadcast(hosts)
    met = scored.join(paths, scored[host].eqNullSafe(paths[h]) & scored[path].eqNullSafe(paths[p]), "left").drop(h, p)
    met = met.join(hosts, met[host].eqNullSafe(hosts[h]), "left").drop(h)
    chance = {}
    for t in TARGETS:
        site = F.coalesce(of_path[t], of_host[t], F.lit(prior[t]))
        chance[t] = 1 / (1 + F.exp(_logit(F.lit(prior[t])) - F.col(evidence_of[t]) - _logit(site)))
    out = met.select(*own, chance["quality"].alias("p_quality"), chance["toxic"].alias("p_toxic"))
    return out.withColumn("kept", (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < TOXIC_LIMIT))
