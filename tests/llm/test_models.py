import numpy as np
import pytest
from compare import DATA
from fixtures import held_out
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import mixing, quality

LABELS = "doc_id long, quality int, toxic int"


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n1, n0 = y.sum(), (1 - y).sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


@pytest.fixture(scope="module")
def big(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_quality_on_held_out(big):
    docs, labels = big
    out = quality.quality_scores(docs, labels)
    assert out.count() == docs.count() and out.columns == [*docs.columns, "held_out", "score", "predicted"]
    x = out.join(labels, "doc_id").filter("held_out").toPandas()
    y = x.quality.to_numpy()
    assert auc(x.score.to_numpy(), y) > 0.95
    assert x.predicted[y == 1].mean() > 0.97 and x.predicted[y == 0].mean() < 0.1
    assert all(held_out(i) for i in x.doc_id) and ((x.score >= 0.7).astype(int) == x.predicted).all()


def test_held_out_labels_change_nothing(big):
    docs, labels = big
    a = quality.quality_scores(docs.select("doc_id", "text"), labels, with_text=False).orderBy("doc_id").collect()
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    b = quality.quality_scores(docs.select("doc_id", "text"), flipped.repartition(3), with_text=False).orderBy("doc_id").collect()
    assert [(r.doc_id, round(r.score, 9)) for r in a] == [(r.doc_id, round(r.score, 9)) for r in b]


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, None), (9, None, 0), (None, 1, 0), (7, 0, 0), (1, 1, 0)], LABELS)
    out = quality.quality_scores(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.text == out[0].text}) == 1
    assert all(r.held_out == (r.doc_id is not None and held_out(r.doc_id)) for r in out)
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(none, labels).count() == 0
    assert quality.quality_scores(odd.withColumn("score", F.lit("x")), labels).columns == [*odd.columns, "held_out", "score", "predicted"]


def test_labels_for_all_documents_or_none(big, tmp_path):
    """Labels that cover every document teach a model; where there are none, the pipeline's stage passes everything."""
    docs, labels = big
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    x = quality.quality_scores(known, labels, with_text=False).join(labels, "doc_id").filter("held_out").toPandas()
    assert x.score.nunique() > 2 and auc(x.score.to_numpy(), x.quality.to_numpy()) > 0.95
    some = corpus_pipeline.quality(docs.sparkSession, known, DATA.replace("sf0.001", "sf0.01"))
    assert 0 < some.count() < known.count() and some.columns == docs.columns
    labels.limit(0).write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality(docs.sparkSession, docs, f"file://{tmp_path}").count() == docs.count()


def local(x, good, fold):
    """Sums and bins of rows that are all here."""
    return lambda models: quality.totals(x, good, fold, models), lambda models: quality.bins(x, good, fold, models)


def test_non_negative_risk():
    """Positives alone on one side, a mixture unlabelled: the model parts them although it sees no negative label."""
    rnd = np.random.default_rng(1)
    good, bad = np.abs(rnd.normal(1, 0.3, (2000, 2))), np.abs(rnd.normal(3, 0.3, (2000, 2)))
    rows = np.vstack([good, bad[:600]])
    scale = quality.Scaler(rows)
    known = np.arange(len(rows)) < 1000
    sums, binned = local(scale(rows), known, np.arange(len(rows)) % quality.FOLDS)
    for w in (quality.pu_weights(sums, 3, 2000 / 2600), quality.learnt(sums, binned, 3)):
        model = quality.Linear(scale, w)
        assert model(good).mean() > 0.8 and model(bad[600:]).mean() < 0.3


def plain_risk(w, p, u, prior):
    """Row by row, from the definition: the non-negative risk, and the negatives' part of it."""

    def mean(rows, sign):
        return sum(np.log(1 + np.exp(-sign * sum(a * b for a, b in zip(w, x)))) for x in rows) / len(rows)

    negative = mean(u, -1) - prior * mean(p, -1)
    return prior * mean(p, 1) + max(0.0, negative), negative


def means(p, u, w):
    x, good = np.vstack([p, u]), np.arange(len(p) + len(u)) < len(p)
    both, positives = quality.totals(x, good, np.zeros(len(x), int), [(-1, w)])[0]
    return quality.Means(both - positives, len(w)), quality.Means(positives, len(w))


def test_risk_and_its_gradient():
    """Loss, slope and curvature that the sums give, against differences of the definition."""
    rnd = np.random.default_rng(3)
    signs = set()
    for prior in (0.1, 0.5, 0.9, 0.95):
        p, u, w = rnd.normal(0.5, 1, (40, 3)), rnd.normal(0.3, 1, (60, 3)), rnd.normal(0, 1.5, 3)
        want, negative = plain_risk(w, p, u, prior)
        _, loss, slope, curve, room = quality.unbiased_risk(prior)(*means(p, u, w), w)
        allowed = room >= 0
        assert np.isclose(quality.negative_risk(*means(p, u, w), prior), negative, atol=1e-6) and allowed == (negative >= 0)
        assert not allowed or np.isclose(loss, want, atol=1e-6)
        signs.add(allowed)
        unbiased = lambda d: (lambda r, m: r - max(0.0, m) + m)(*plain_risk(w + d, p, u, prior))
        assert np.allclose(slope, [(unbiased(1e-5 * e) - unbiased(-1e-5 * e)) / 2e-5 for e in np.eye(3)], atol=1e-5)
        steps = [(unbiased(1e-3 * (a + b)) - unbiased(1e-3 * (a - b)) - unbiased(1e-3 * (b - a)) + unbiased(-1e-3 * (a + b))) / 4e-6 for a in np.eye(3) for b in np.eye(3)]
        assert np.allclose(curve.ravel(), steps, atol=1e-4)
    p, u = rnd.normal(2, 1, (40, 3)), rnd.normal(-2, 1, (60, 3))
    w = np.array([3.0, 3.0, 3.0])
    assert quality.unbiased_risk(0.9)(*means(p, u, w), w).room < 0


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.8, 0.99])
def test_descent_ends_at_least_risk_or_at_the_edge(prior):
    """Where the negatives' risk is well above 0, no point nearby has less risk; else the descent went as far as it may."""
    rnd = np.random.default_rng(8)
    p, u = np.column_stack([rnd.normal(1, 1, (300, 2)), np.ones(300)]), np.column_stack([rnd.normal(0, 1.5, (500, 2)), np.ones(500)])
    x, good = np.vstack([p, u]), np.arange(800) < 300
    w = quality.pu_weights(lambda models: quality.totals(x, good, np.zeros(800, int), models), 3, prior)
    ridge = lambda v: (quality.RIDGE + 1 / 800) * (v[:-1] ** 2).sum() / 2
    here, negative = plain_risk(w, p, x, prior)
    start = plain_risk(np.array([0, 0, np.log(prior / (1 - prior))]), p, x, prior)[0]
    assert negative > -1e-6 and here + ridge(w) <= start
    if prior > 0.9:  # unlabelled rows rule such a prior out: any step of use takes the negatives' risk below 0
        return
    assert here + ridge(w) < start
    steps = np.vstack([np.eye(3), -np.eye(3)]) * 0.02
    lower = [e for e in steps if plain_risk(w + e, p, x, prior)[0] + ridge(w + e) < here + ridge(w) - 1e-5]
    assert not lower or negative < 0.01


def plain_scores(rows, labels):
    """The whole operator in one place: all rows in memory, sums of floats, Newton steps that are halved until they gain."""
    from strandline.llm.textfeatures import features

    def x_of(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return features(data, np.array([0, len(data)]))[0][0][quality._FORM]

    x = np.array([x_of(t) for _, t in rows])
    learn = np.array([i is not None and not held_out(i) for i, _ in rows])
    good = learn & np.array([i in labels and labels[i] == 1 for i, _ in rows])
    mean, std = np.sqrt(x[learn]).mean(axis=0), np.sqrt(x[learn]).std(axis=0) + 1e-3
    z = np.column_stack([np.clip((np.sqrt(x) - mean) / std, -3, 3), np.ones(len(x))])

    def newton(w, of, parts, n):
        ridge = np.array([quality.RIDGE + 1 / n] * (z.shape[1] - 1) + [0])
        value = lambda v: (lambda f: f[0] + (ridge * v * v).sum() / 2 if f else np.inf)(of(v))
        while True:
            _, slope, curve = of(w)
            step = np.linalg.solve(curve + np.diag(ridge + 1e-9), -(slope + ridge * w))
            best = min((w + s * step for s in parts), key=value)
            if value(best) < value(w):
                gain, w = value(w) - value(best), best
            if value(best) >= value(w) + 1e-12 or gain < quality.CLOSE:
                return w

    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    curved = lambda v, w: (v * (lambda s: s * (1 - s))(sigmoid(v @ w))[:, None]).T @ v / len(v)

    def apart(p, u):
        return lambda w: ((np.logaddexp(0, -p @ w).mean() + np.logaddexp(0, u @ w).mean()) / 2, ((sigmoid(p @ w) - 1) @ p / len(p) + sigmoid(u @ w) @ u / len(u)) / 2, (curved(p, w) + curved(u, w)) / 2)

    def risk(p, u, prior):
        def of(w):
            if np.logaddexp(0, u @ w).mean() < prior * np.logaddexp(0, p @ w).mean():
                return None
            return prior * np.logaddexp(0, -p @ w).mean() + np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean(), sigmoid(u @ w) @ u / len(u) - prior * p.mean(axis=0), curved(u, w)

        return of

    return z, learn, good, newton, apart, risk


def test_scores_match_a_version_in_one_place(big, spark):
    docs, labels = big
    table = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    known = {r.doc_id: r.quality for r in labels.collect()}
    z, learn, good, newton, apart, risk = plain_scores(table, known)
    ids = spark.createDataFrame([(i,) for i, _ in table], "id long")
    fold_of = {r.id: r.fold for r in ids.select("id", F.pmod(F.xxhash64("id"), F.lit(quality.FOLDS)).alias("fold")).collect()}
    fold = np.array([fold_of[i] for i, _ in table])
    counts = np.zeros((2, quality.BINS), int)
    for k in range(quality.FOLDS):
        w = newton(np.zeros(z.shape[1]), apart(z[good & (fold != k)], z[learn & (fold != k)]), quality.STEPS[::2], (learn & (fold != k)).sum())
        for kind, rows in enumerate((good & (fold == k), learn & (fold == k))):
            counts[kind] += np.histogram(np.clip(z[rows] @ w, -quality.LIMIT, quality.LIMIT - 1e-9), bins=quality.BINS, range=(-quality.LIMIT, quality.LIMIT))[0]
    prior = quality.best_bin(*counts)
    start = np.zeros(z.shape[1])
    start[-1] = np.log(prior / (1 - prior))
    want = 1 / (1 + np.exp(-z @ newton(start, risk(z[good], z[learn], prior), quality.STEPS, learn.sum())))
    got = {r.doc_id: r.score for r in quality.quality_scores(docs.select("doc_id", "text"), labels, with_text=False).collect()}
    assert max(abs(got[i] - x) for (i, _), x in zip(table, want, strict=True)) < 2e-3


@pytest.mark.parametrize("unlabelled", [0, 1, 3, 10, 30, 100, None])
def test_any_number_of_unlabelled_documents(big, unlabelled):
    """Labels may cover all documents, nearly all, or some: junk goes and the rest stays."""
    docs, labels = big
    rest = docs.join(labels.select("doc_id"), "doc_id", "left_anti").select(*docs.columns).orderBy("doc_id")
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select(*docs.columns).unionByName(rest if unlabelled is None else rest.limit(unlabelled))
    kept = {r.doc_id for r in corpus_pipeline.quality(docs.sparkSession, some, DATA.replace("sf0.001", "sf0.01")).select("doc_id").collect()}
    x = labels.join(some.select("doc_id"), "doc_id", "left_semi").toPandas()
    x["kept"] = x.doc_id.isin(kept)
    for rows in (x, x[x.doc_id.map(held_out)]):
        assert rows.kept[rows.quality == 1].mean() >= 0.97 and rows.kept[rows.quality == 0].mean() <= 0.1


@pytest.mark.parametrize("positives", [1, 2, 40])
def test_few_positives(spark, big, positives):
    """Two positives bound no prior: it is 0.5 then; scores stay between 0 and 1 and differ."""
    docs, labels = big
    few = labels.filter("quality = 1").filter(~quality.held_out()).orderBy("doc_id").limit(positives)
    scores = [r.score for r in quality.quality_scores(docs.select("doc_id", "text"), few, with_text=False).collect()]
    assert len(set(scores)) > 100 and all(0 <= s <= 1 for s in scores)
    counts = np.zeros(quality.BINS, int)
    counts[100] = positives
    assert (quality.best_bin(counts, counts * 50) == 0.5) == (positives < 3)


def test_very_long_texts(spark):
    """Texts of some megabytes beside short ones."""
    rows = [(k, f"Some plain words, number {k}. " * (100_000 if k % 20 == 0 else 5)) for k in range(60)]
    out = quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, 1, 0) for k in range(30)], LABELS)).collect()
    assert len(out) == 60 and all(len(r.text) == len(rows[r.doc_id][1]) and 0 <= r.score <= 1 for r in out)


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_is_estimated_without_negatives(prior):
    rnd = np.random.default_rng(5)
    n = 20_000
    p = rnd.normal(2, 1, n)
    u = np.where(rnd.random(n) < prior, rnd.normal(2, 1, n), rnd.normal(-2, 1, n))
    counts = [np.histogram(x, bins=quality.BINS, range=(-10, 10))[0] for x in (p, u)]
    assert abs(quality.best_bin(*counts) - prior) < 0.04
    assert quality.best_bin(np.zeros(5, int), counts[1][:5]) == 0.5


def test_prior_of_biased_labels(big):
    """Labels that only some good documents have do not make the estimate: the share among labels would be 1."""
    docs, labels = big
    good = labels.filter("quality = 1")
    x = quality.quality_scores(docs, good, with_text=False).join(labels, "doc_id").filter("held_out").toPandas()
    y = x.quality.to_numpy()
    assert x.predicted[y == 1].mean() > 0.95 and x.predicted[y == 0].mean() < 0.2


def test_mixing_meets_its_targets(big):
    docs, labels = big
    out = mixing.mix(docs, labels)
    assert out.columns == [*docs.columns, "n_tokens", "p_low", "p_clean", "p_toxic", "rate", "copies"]
    x = out.toPandas()
    p = x[["p_low", "p_clean", "p_toxic"]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5) and (x.rate >= 0).all()
    tokens = (p * (x.n_tokens * x.rate).to_numpy()[:, None]).sum(axis=0)
    assert np.allclose(tokens / tokens.sum(), [mixing.TARGETS[d] for d in mixing.DOMAINS], atol=1e-3)
    drawn = (p * (x.n_tokens * x.copies).to_numpy()[:, None]).sum(axis=0)
    assert np.allclose(drawn / drawn.sum(), [mixing.TARGETS[d] for d in mixing.DOMAINS], atol=0.02)
    y = out.join(labels, "doc_id").filter(quality.held_out()).toPandas()
    best = y[["p_low", "p_clean", "p_toxic"]].to_numpy().argmax(axis=1)
    want = np.where(y.quality == 0, 0, np.where(y.toxic == 1, 2, 1))
    assert (best == want).mean() > 0.85
    assert mixing.repeat_copies(out).count() == x.copies.sum()


def test_rates_match_a_dense_solver(spark):
    """Distributed steps against projected gradient in one place, with targets that only rates held at 0 come near."""
    rnd = np.random.default_rng(2)
    p, n = rnd.dirichlet([0.4, 1, 0.3], 300), rnd.integers(1, 500, 300)
    table = spark.createDataFrame([(int(k), *map(float, np.round(x, 6))) for k, x in zip(n, p, strict=True)], "n long, p0 double, p1 double, p2 double").repartition(7)
    steps, got, goal = mixing.fit_rates(table, {"low": 0.0, "clean": 0.9, "toxic": 0.1})
    a = (p * n[:, None]).T
    m = a @ p
    m = np.linalg.inv(m + mixing.DAMPING * np.linalg.eigvalsh(m)[-1] * np.eye(3))
    r = np.ones(300)
    for _ in range(4000):
        r = np.maximum(0, r - p @ (m @ (a @ r - goal)))
    error = lambda t: (t - goal) @ m @ (t - goal)
    assert (mixing.rates(p, steps)[0] == 0).any() and error(got) <= error(a @ np.ones(300)) * 0.2
    assert error(got) <= error(a @ r) * 1.5 + 1e-3 * error(a @ np.ones(300))


def test_pipeline_mixing_keeps_clean_documents(big):
    """A document whose likeliest domain is clean is never drawn 0 times, and one of low quality never twice."""
    docs, labels = big
    free = mixing.mix(docs, labels, corpus_pipeline.TARGETS).toPandas()
    clean = lambda x: x.p_clean >= x[["p_low", "p_toxic"]].max(axis=1)
    assert (free.copies[clean(free)] == 0).any()
    x = mixing.mix(docs, labels, corpus_pipeline.TARGETS, bounds=corpus_pipeline.BOUNDS).toPandas()
    assert (x.copies[clean(x)] >= 1).all() and (x.copies[~clean(x) & (x.p_low > x.p_toxic)] <= 1).all()
    folder = DATA.replace("sf0.001", "sf0.01")
    drawn = corpus_pipeline.mixing(docs.sparkSession, docs, folder).select("doc_id").distinct().toPandas()
    assert set(x.doc_id[clean(x)].dropna()) <= set(drawn.doc_id.dropna())
    even = mixing.mix(docs.limit(50), labels.limit(0), corpus_pipeline.TARGETS, bounds=corpus_pipeline.BOUNDS)
    assert even.filter("copies < 1").isEmpty()
    with pytest.raises(ValueError):
        mixing.mix(docs, labels, bounds={"clean": (2, 3)})


def test_mixing_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (12, 0, 0), (9, 1, 1), (9, 1, 1), (None, 0, 0), (8, None, None)], LABELS)
    out = mixing.mix(odd, labels).collect()
    assert len(out) == odd.count() and all(r.copies == 1 for r in out if not (r.text or "").split())
    assert len({(r.rate, r.copies) for r in out if r.doc_id == 2}) == 1
    assert mixing.mix(odd, labels.limit(0)).count() == odd.count() and mixing.mix(none, labels).count() == 0
    assert mixing.mix(odd.withColumn("rate", F.lit(1)), labels, with_text=False).columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "p_low", "p_clean", "p_toxic", "rate", "copies"]
    with pytest.raises(ValueError):
        mixing.mix(odd, labels, {"low": 1})
