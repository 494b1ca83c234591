import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.catalog import Catalog, Instrument
from cohortloom.cohort import Cohort
from cohortloom.functions.recode import release_rules
from cohortloom.operators.mixture import SWEEP_METRICS, Descriptor, assign_classes, fit_mixtures, load_mixture, mixture_metrics, mixture_of, parameter_table, score_fits
from cohortloom.operators.profile import column_kinds
from cohortloom.operators.regress import Linear, cross_validate, linear_models, r2_score, score_linear, tree_models
from cohortloom.plans.latent import class_sweep, latent_class_job, optimal_k_job
from cohortloom.plans.phenotype import phenotype_job
from cohortloom.plans.predictability import predictability, regression_job
from cohortloom.plans.prepare import prepare, release_spec, wide_frame
from cohortloom.release_catalog import HISTORY_COLUMNS, release_catalog

X = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def linear_data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3)) * [1.0, 5.0, 0.1] + [100.0, 0.0, -3.0]
    y = 2.0 * x[:, 0] - x[:, 1] + rng.normal(size=90)
    fold = np.arange(90) % 3
    df = spark.createDataFrame(
        [(i, *map(float, row), float(t), int(f)) for i, (row, t, f) in enumerate(zip(x, y, fold))],
        "id int, x0 double, x1 double, x2 double, y double, fold int",
    ).persist()
    return df, x, y, fold


def closed_form(x, y, fold, penalty, alpha):
    out = []
    for f in sorted(set(fold)):
        tr, te = fold != f, fold == f
        mu, sd = x[tr].mean(0), x[tr].std(0)
        z, c = (x[tr] - mu) / sd, y[tr].mean()
        if penalty == "ridge":
            beta = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y[tr] - c))
        elif penalty == "lasso":
            beta = np.zeros(3)
            for _ in range(5000):
                for j in range(3):
                    r = y[tr] - c - z @ beta + z[:, j] * beta[j]
                    rho = z[:, j] @ r / tr.sum()
                    beta[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / (z[:, j] @ z[:, j] / tr.sum())
        else:
            beta = np.linalg.lstsq(z, y[tr] - c, rcond=None)[0]
        p = (x[te] - mu) / sd @ beta + c
        out.append(1 - ((y[te] - p) ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum())
    return out


@pytest.mark.parametrize("penalty,alpha", [(None, 0.0), ("ridge", 1.0), ("ridge", 40.0), ("lasso", 1.0), ("lasso", 0.2)])
def test_one_pass_scores_match_row_level_fits(linear_data, penalty, alpha):
    df, x, y, fold = linear_data
    got = [r2 for _, _, r2 in score_linear(df, X, "y", "fold", {"m": Linear(penalty, alpha)})]
    assert got == pytest.approx(closed_form(x, y, fold, penalty, alpha), abs=1e-8)


def test_collinear_columns_do_not_break_least_squares(spark, linear_data):
    df = linear_data[0].withColumn("x3", F.col("x0") * 2).withColumn("x4", F.lit(1.0))
    wide = [r2 for _, _, r2 in score_linear(df, [*X, "x3", "x4"], "y", "fold", {"m": Linear()})]
    narrow = [r2 for _, _, r2 in score_linear(df, X, "y", "fold", {"m": Linear()})]
    assert wide == pytest.approx(narrow, abs=1e-6)


def test_constant_target_scores_are_finite(spark):
    data = [(i, float(i % 4), 5.0, i % 2) for i in range(20)]
    df = spark.createDataFrame(data, "id int, x double, y double, fold int")
    assert [r2 for _, _, r2 in score_linear(df, ["x"], "y", "fold", {"m": Linear()})] == [1.0, 1.0]
    worthless = df.withColumn("p", F.col("y") + 1.0)
    assert r2_score(df, "y", "y").first()["r2"] == 1.0 and r2_score(worthless, "y", "p").first()["r2"] == 0.0


def test_registry_takes_any_estimator(spark, linear_data):
    df = linear_data[0]
    models = {**linear_models(), **tree_models(boost_rounds=2, forest_size=3, forest_depth=3)}
    scores = cross_validate(spark, df, X, "y", "fold", models).collect()
    assert len(scores) == 5 * 3 and {r["model"] for r in scores} == set(models)
    with pytest.raises(ValueError):
        Linear("elastic")


def test_estimators_share_the_passes_around_their_fits(spark, linear_data):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df = linear_data[0].withColumn("x3", F.lit(7.0))
    own = LinearRegression(regParam=0.3, elasticNetParam=0.0, solver="normal", standardization=False)
    context = spark.sparkContext
    context.setJobGroup("fits", "")
    scores = cross_validate(spark, df, [*X, "x3"], "y", "fold", {"Own": own}).collect()
    # Two jobs inside every fit; the scaling and the scores of all folds are one pass each.
    jobs = context.statusTracker().getJobIdsForGroup("fits")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2 * 3 + 8
    for r in scores:
        stages = [VectorAssembler(inputCols=[*X, "x3"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), own.copy().setFeaturesCol("scaled").setLabelCol("y")]
        rows = Pipeline(stages=stages).fit(df.filter(F.col("fold") != r["fold"])).transform(df.filter(F.col("fold") == r["fold"]))
        assert r["r2"] == pytest.approx(r2_score(rows, "y", "prediction").first()["r2"], abs=1e-9)
    broken = df.withColumn("x1", F.when(F.col("id") != 5, F.col("x1")))
    with pytest.raises(Exception, match="missing value in x1"):
        cross_validate(spark, broken, X, "y", "fold", {"Own": own})


@pytest.fixture(scope="module")
def classes(spark):
    """Planted classes over every column kind, membership driven by a covariate."""
    rng = np.random.default_rng(7)
    n = 1200
    z = rng.normal(size=n)
    truth = (rng.random(n) < 1 / (1 + np.exp(-1.5 * z))).astype(int)
    binary = (rng.random(n) < np.where(truth == 1, 0.9, 0.15)).astype(float)
    binary2 = (rng.random(n) < np.where(truth == 1, 0.2, 0.8)).astype(float)
    level = np.where(truth == 1, rng.choice([0.0, 2.0, 5.0], n, p=[0.7, 0.2, 0.1]), rng.choice([0.0, 2.0, 5.0], n, p=[0.1, 0.2, 0.7]))
    size = rng.normal(np.where(truth == 1, 3.0, 0.0), 1.0)
    data = [(i, *map(float, r)) for i, r in enumerate(zip(binary, binary2, level, size, z))]
    df = spark.createDataFrame(data, "id int, b double, b2 double, c double, g double, z double").repartition(4).persist()
    d = Descriptor.from_kinds(column_kinds(df, ["b", "b2", "c", "g"]), ["z"])
    return df, d, truth


def test_descriptor_and_parameter_count(classes):
    _, d, _ = classes
    assert (d.binary, d.continuous, d.categorical, d.levels) == (("b", "b2"), ("g",), ("c",), ((0.0, 2.0, 5.0),))
    assert d.n_parameters(2) == 2 * (2 + 2 + 2) + 2


def test_mixture_recovers_planted_classes(spark, classes):
    df, d, truth = classes
    fitted = fit_mixtures(df, "id", d, [2], restarts=3, tol=1e-6, max_iter=300)
    for f in fitted.fits:
        assert all(b >= a - 1e-6 for a, b in zip(f.trace, f.trace[1:])), "the likelihood must not fall"
    best = fitted.best()[0]
    assert best.log_likelihood == max(f.log_likelihood for f in fitted.fits) and best.shares[0] >= best.shares[1]
    labels = {r["id"]: r["label"] for r in assign_classes(df, "id", fitted.layout, best, True).collect()}
    agree = np.mean([labels[i] == t for i, t in enumerate(truth)])
    assert max(agree, 1 - agree) > 0.9
    coefficients = parameter_table(spark, fitted.layout, best).filter("parameter = 'coefficient'").collect()
    assert max(abs(r["value"]) for r in coefficients) == pytest.approx(1.5, abs=0.5)
    sizes = sorted(float(v) for v in best.mean[:, 0])
    assert sizes == pytest.approx([0.0, 3.0], abs=0.3)


def test_mixture_scores_agree_with_row_level_assignments(spark, classes):
    df, d, _ = classes
    fitted = fit_mixtures(df, "id", d, [2, 3], restarts=1, max_iter=15)
    best = fitted.best()
    for fit, (ll, _, n) in zip(best, score_fits(df, fitted.layout, best)):
        total = assign_classes(df, "id", fitted.layout, fit).agg(F.sum("log_likelihood")).first()[0]
        assert n == df.count() and ll == pytest.approx(total)
    table = {r["k"]: r for r in mixture_metrics(df, fitted).collect()}
    assert set(table) == {2, 3} and all(0 <= r["scaled_entropy"] <= 1 for r in table.values())
    assert table[2]["caic"] == pytest.approx(table[2]["bic"] + table[2]["n_parameters"])


def test_mixture_of_one_class_is_the_marginal(classes):
    df, d, _ = classes
    fit = fit_mixtures(df, "id", d, [1]).best()[0]
    assert fit.shares == pytest.approx([1.0]) and fit.p_binary[0][0] == pytest.approx(df.agg(F.avg("b")).first()[0])


@pytest.fixture(scope="module")
def release_cohort(spark):
    """A small release with every table the preparation reads."""
    rng = np.random.default_rng(11)
    n = 160

    def table(cols, first=0, size=n):
        data = [(f"s{first + i}", *[make(i) for _, _, make in cols]) for i in range(size)]
        return spark.createDataFrame(data, ", ".join(["subject_sp_id string", *(f"{c} {t}" for c, t, _ in cols)]))

    age = ("age_at_eval_years", "int", lambda i: int(rng.integers(3, 20)))
    missing = ("missing_values", "int", lambda i: int(rng.random() < 0.1))
    scq = table([missing, ("sex", "string", lambda i: ["Male", "Female"][i % 2]), ("asd", "boolean", lambda i: True), age,
                 *[(f"q0{q}_x", "int", lambda i: int(rng.integers(0, 2))) for q in range(1, 6)],
                 ("final_score", "int", lambda i: int(rng.integers(0, 39)))])
    rbsr = table([missing, age, *[(f"q0{q}_y", "int", lambda i: int(rng.integers(0, 4))) for q in range(1, 4)],
                  *[(c, "int", lambda i: int(rng.integers(0, 20))) for c in release_catalog().from_code("rbsr").subscales],
                  ("total_final_score", "int", lambda i: int(rng.integers(0, 60)))])
    social = ("close_friends", "contact_friends_outside_school", "gets_along_siblings", "gets_along_other_kids", "behave_with_parents", "play_work_alone")
    cbcl = table([*[(c, "string", lambda i: ["none", "1", "2_3", "better"][int(rng.integers(0, 4))]) for c in social],
                  *[(f"q00{q}_z", "int", lambda i: int(rng.integers(0, 3))) for q in range(1, 4)],
                  *[(c, "int", lambda i: int(rng.integers(50, 90))) for c in release_catalog().from_code("cbcl_6_18").subscales],
                  ("total_problems_t_score", "int", lambda i: int(rng.integers(30, 90)))], first=5)
    texts = {"child_lives_with": ["both_joint", "-"], "child_lives_with_v2": ["both_parents", "-"], "gender": ["male", "female"],
             "mother_highest_education": ["some_college"], "father_highest_education": ["trade_school"], "hand": ["left", "right"],
             "annual_household_income": ["over_161000"], "child_grade_school": ["7", "college"], "twin_mult_birth": ["no", "twin"]}

    def history(first, extra):
        cols = []
        for c in HISTORY_COLUMNS:
            if c == "age_at_eval_years":
                cols.append(age)
            elif c in texts:
                cols.append((c, "string", lambda i, v=texts[c]: v[int(rng.integers(0, len(v)))]))
            else:
                cols.append((c, "int", lambda i: int(rng.integers(0, 30))))
        return table([*cols, (extra, "int", lambda i: 1)], first, 100)

    tables = {"SCQ": scq, "RBSR": rbsr, "CBCL_6_18": cbcl, "BHC": history(0, "only_child"), "BHS": history(100, "only_sibling"),
              "DCDQ": table([*[(f"q0{q}_w", "int", lambda i: int(rng.integers(1, 6))) for q in range(1, 3)], ("final_score", "int", lambda i: int(rng.integers(15, 75)))])}
    return Cohort(release_catalog(), {c: df.persist() for c, df in tables.items()})


def pandas_preparation(cohort, ids):
    """Row-level check of the flow with pandas."""
    import pandas as pd

    frames = {c: df.toPandas().set_index("subject_sp_id") for c, df in cohort.tables.items()}
    spec = release_spec(cohort)
    hist = pd.concat([frames[c][[*HISTORY_COLUMNS]].query("4 <= age_at_eval_years <= 18") for c in ("BHC", "BHS")]).add_prefix("BHC_")
    df = None
    for code in ("SCQ", "RBSR", "CBCL_6_18"):
        cols = [f.source_col for f in spec.features if f.inst_code == code]
        part = frames[code][cols].add_prefix(f"{code}_")
        df = part if df is None else df.join(part, how="outer")
    df = df.join(hist)
    df = df[df["SCQ_age_at_eval_years"].between(4, 18) & (df["SCQ_missing_values"] < 1) & df["RBSR_age_at_eval_years"].between(4, 18) & (df["RBSR_missing_values"] < 1)]
    df = df.drop(columns=spec.ephemeral)
    for cols, mapping in release_rules([f.col for f in spec.features if f.inst_code == "CBCL_6_18"]):
        for c in cols:
            if df[c].dtype == object:
                df[c] = [mapping.get(v, v) if isinstance(v, str) else v for v in df[c]]
    df = df[df.index.isin(ids)]
    df = df.loc[:, df.isna().sum() / len(df) < 0.1].dropna()
    return df.astype("float64").round()


def test_release_preparation_matches_pandas(spark, release_cohort):
    ids = [f"s{i}" for i in range(5, 100)]
    id_df = spark.createDataFrame([(i,) for i in [*ids, *ids]], "subject_sp_id string")
    ready = prepare(release_cohort, release_spec(release_cohort), id_df)
    want = pandas_preparation(release_cohort, set(ids))
    got = ready.df.toPandas().set_index("subject_sp_id")
    assert len(got) > 10 and sorted(got.columns) == sorted(want.columns)
    assert got.sort_index()[sorted(got.columns)].equals(want.sort_index()[sorted(want.columns)])
    assert ready.descriptor.covariates == ("SCQ_sex", "SCQ_age_at_eval_years")
    assert not set(ready.indicators) & set(ready.descriptor.covariates)
    sampled = prepare(release_cohort, release_spec(release_cohort, sample_frac=0.5), id_df)
    assert sampled.df.count() == round(0.5 * len(want))


def test_no_stage_of_the_preparation_repeats_the_joins(release_cohort):
    """The plan ahead of the profile reads written rows: with the joins repeated in it, one task held the memory of dozens of operators."""
    codes = release_cohort.tables
    ids = codes["SCQ"].select(release_cohort.key)
    plan = wide_frame(release_cohort, release_spec(release_cohort), ids)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Sort [") + plan.count("HashAggregate(") <= 16


def test_latent_class_job_stores_parameters(spark, release_cohort, tmp_path):
    path, labels = latent_class_job(release_cohort, release_spec(release_cohort), str(tmp_path), n_components=2, max_iter=5)
    assert spark.read.parquet(path).filter("parameter = 'share'").count() == 2 and labels.count() > 10


def test_class_sweep_table(release_cohort):
    ready = prepare(release_cohort, release_spec(release_cohort))
    rows = class_sweep(ready, "subject_sp_id", [2], repeats=2, restarts=2, max_iter=4).collect()
    assert [(r["k"], r["repeat"]) for r in rows] == [(2, 0), (2, 1)]


def test_phenotype_job_reads_its_cache(release_cohort, tmp_path):
    codes = ["SCQ", "CBCL_6_18", "RBSR", "DCDQ"]
    first = phenotype_job(release_cohort, "final_score", codes, str(tmp_path), "r1", k_values=[2], repeats=1)
    again = phenotype_job(release_cohort, "final_score", codes, str(tmp_path), "r1", k_values=[2], repeats=1)
    assert sorted(map(tuple, first["gmm"].collect())) == sorted(map(tuple, again["gmm"].collect()))
    assert first["k_means"].count() == 4


def test_phenotype_job_joins_once(release_cohort, tmp_path, monkeypatch):
    """Both sweeps get the same kept rows; each used to repeat the join, for its moments and for its points."""
    from cohortloom.plans import phenotype

    seen = []
    for name in ("run_k_means", "run_gmm"):
        run = getattr(phenotype, name)
        monkeypatch.setattr(phenotype, name, lambda df, *args, run=run, **options: seen.append((df, df.storageLevel.useMemory)) or run(df, *args, **options))
    phenotype_job(release_cohort, "final_score", ["SCQ", "RBSR"], str(tmp_path), "once", k_values=[2], repeats=1)
    assert [kept for _, kept in seen] == [True, True] and seen[0][0] is seen[1][0] and not seen[0][0].storageLevel.useMemory


def test_latent_labels_are_counted_before_they_are_named(spark, sf_dir):
    """Joined by label, all rows of a class would meet in one task."""
    from registry.planted_queries import latent_planted

    plan = latent_planted(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Aggregate [label")


def test_scans_have_a_whole_number_of_tasks_per_core(spark):
    from cohortloom.operators.passes import PARTITION_VALUES, partitions_for

    cores = spark.sparkContext.defaultParallelism
    assert partitions_for(spark, 10, 4) == cores and partitions_for(spark, PARTITION_VALUES * (cores + 1), 1) == 2 * cores


def test_predictability_pairs(release_cohort, tmp_path):
    models = {"Linear": Linear()}
    rows = predictability(release_cohort, ["SCQ", "RBSR"], models, reps=50).collect()
    assert {(r["question_inst"], r["score_inst"]) for r in rows} == {("SCQ", "RBSR"), ("RBSR", "SCQ")}
    assert all(r["n"] == 160 and r["ci_low"] <= r["r2_mean"] <= r["ci_high"] for r in rows)
    out = regression_job(release_cohort, ["SCQ", "RBSR"], str(tmp_path), "r1", models, reps=50)
    assert out["r2"].count() == 2 and out["counts"].filter("light_text").count() == 2


def test_pairs_skip_instruments_without_roles(release_cohort):
    assert release_cohort.catalog.score_pairs(["BHC", "SCQ"]) == []
    assert isinstance(release_cohort.catalog, Catalog) and Instrument("x", "x").question_features is None


def test_latent_class_starts_find_planted_classes(spark):
    """One restart is enough for two perfectly planted classes, whatever the seed."""
    rows = [(i, *([float(i % 2)] * 4), 5.0 * (i % 2)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, g double").persist()
    d = Descriptor(binary=("a", "b", "c", "d"), continuous=("g",))
    for seed in range(20):
        fit = fit_mixtures(df, "id", d, [2], restarts=1, max_iter=60, seed=seed).best()[0]
        assert sorted(np.round(fit.p_binary[:, 0], 3)) == [0.0, 1.0], seed
        assert np.allclose(fit.shares, 0.5, atol=1e-3)


def test_model_queries_keep_the_default_settings(spark, sf_dir, monkeypatch):
    from registry import model_queries as registered

    seen = {}

    class Stop(Exception):
        pass

    def record(name):
        def call(*args, **options):
            seen[name] = (args, options)
            raise Stop

        return call

    for name in ("fit_mixtures", "class_sweep", "optimal_k_job", "latent_class_job", "cross_validate", "regression_job"):
        monkeypatch.setattr(registered, name, record(name))
    monkeypatch.setattr(registered, "tree_models", lambda **options: seen.setdefault("tree_models", options) or tree_models())
    for query in ("class_fit", "class_restarts", "class_parameters", "sweep", "optimal_k", "latent_job", "boosted", "forest", "regression"):
        with pytest.raises(Stop):
            getattr(registered, query)(spark, sf_dir)
        for name in ("fit_mixtures", "class_sweep", "optimal_k_job", "latent_class_job"):
            args, options = seen.get(name, ((), {}))
            assert not {"max_iter", "repeats", "k_values"} & set(options) and options.get("restarts", 20) == 20, query
    assert seen["tree_models"] == {} and len(seen["regression_job"][0]) == 4 and not seen["regression_job"][1]
    assert len(seen["class_sweep"][0]) == 2 and len(seen["optimal_k_job"][0]) == 4
    folds = seen["cross_validate"][0][1].select("fold").distinct().count()
    assert folds == 5


def test_accelerated_steps_reach_the_same_optimum_in_half_the_scans(spark):
    """Overlapping classes converge slowly; the path of the likelihood never falls."""
    rng = np.random.default_rng(4)
    truth = rng.integers(0, 2, 2000)
    rows = [(i, float(rng.normal(2.0 * t)), float(rng.random() < 0.3 + 0.4 * t), float(rng.random() < 0.6 - 0.3 * t)) for i, t in enumerate(truth)]
    df = spark.createDataFrame(rows, "id int, g double, b double, c double").coalesce(1).persist()
    d = Descriptor(binary=("b", "c"), continuous=("g",))
    plain, quick = (fit_mixtures(df, "id", d, [2], tol=1e-7, max_iter=250, accelerate=a).best()[0] for a in (False, True))
    assert plain.converged and quick.converged and quick.iterations <= plain.iterations / 2, (plain.iterations, quick.iterations)
    assert quick.log_likelihood >= plain.log_likelihood - 1e-2
    assert all(b >= a - 1e-6 for a, b in zip(quick.trace, quick.trace[1:]))
    assert quick.shares == pytest.approx(plain.shares, abs=5e-2) and np.sort(quick.mean[:, 0]) == pytest.approx([0.0, 2.0], abs=0.3)


def test_stored_mixture_predicts_as_before(spark, classes, tmp_path):
    df, d, _ = classes
    fitted = fit_mixtures(df, "id", d, [3], max_iter=12)
    best = fitted.best()[0]
    parameter_table(spark, fitted.layout, best).repartition(3).write.parquet(str(tmp_path / "m"))
    layout, loaded = load_mixture(spark, str(tmp_path / "m"))
    assert layout.d == d and loaded.k == 3
    for with_covariates in (False, True):
        before = {r["id"]: r for r in assign_classes(df, "id", fitted.layout, best, with_covariates).collect()}
        after = assign_classes(df, "id", layout, loaded, with_covariates).collect()
        assert len(after) == len(before)
        for r in after:
            assert r["label"] == before[r["id"]]["label"] and r["probabilities"] == pytest.approx(before[r["id"]]["probabilities"], abs=1e-9)
    table = spark.read.parquet(str(tmp_path / "m"))
    for broken in (table.filter("parameter <> 'version'"), table.withColumn("value", F.when(F.col("parameter") == "version", 9.0).otherwise(F.col("value"))),
                   table.filter("NOT (class = 1 AND parameter = 'variance')"), table.drop("level")):
        with pytest.raises(ValueError):
            mixture_of(broken)
    with pytest.raises(ValueError, match="needs the columns"):
        assign_classes(df.drop("g"), "id", layout, loaded)


def test_user_metrics_join_the_sweep_and_its_cache(release_cohort, tmp_path):
    ready = prepare(release_cohort, release_spec(release_cohort))
    limits = {"k_values": [2], "repeats": 1, "restarts": 1}

    def job(metrics, **more):
        return optimal_k_job(ready, "subject_sp_id", str(tmp_path), "r1", metrics=metrics, **limits, **more)

    job(SWEEP_METRICS)
    own = {**SWEEP_METRICS, "sure": lambda s: s["sure_rows"] / s["rows"]}
    row = job(own, row_statistics={"sure_rows": lambda r, ll: (r.max(1) > 0.9).sum()}).first()
    assert 0.0 <= row["mean_sure"] <= 1.0 and row["std_sure"] == 0.0
    job({"sure": lambda s: 2.0 * s["rows"]})
    job({"sure": lambda s: 3.0 * s["rows"]})
    assert len(list((tmp_path / "classes").iterdir())) == 4
    job({"sure": lambda s: 3.0 * s["rows"]})
    assert len(list((tmp_path / "classes").iterdir())) == 4


def test_preparation_without_filters(spark):
    from cohortloom.operators.frame import within

    df = spark.createDataFrame([(1, None), (2, 3.0)], "id int, x double")
    assert within(df, {}).count() == 2 and within(df, {"x": (1, 5)}).count() == 1


def test_fits_of_one_size_share_their_products():
    """Statistics of many mixtures from shared products equal those one by one, also where a variance is too small for products."""
    import pyarrow as pa

    from cohortloom.operators import mixture

    rng = np.random.default_rng(4)
    d = mixture.Descriptor(("b",), ("c1", "c2"), ("g",), ((0.0, 1.0, 2.0),), ("z",))
    x = np.column_stack([rng.integers(0, 2, 400), rng.normal(5, 2, 400), rng.normal(0, 100, 400), rng.integers(0, 3, 400), rng.normal(size=400)]).astype(float)
    layout = mixture._Layout(d, np.array([5.0, 0.0]), np.zeros(1), np.ones(1))

    def fit(k, restart, variance):
        return mixture.MixtureFit(
            k, 0, restart, rng.uniform(0.1, 0.9, (k, 1)), rng.normal(5, 2, (k, 2)), np.full((k, 2), variance), rng.dirichlet(np.ones(3), k),
            np.vstack([np.zeros(2), rng.normal(size=(k - 1, 2))]), np.full(k, 1.0 / k),
        )

    fits = [fit(3, 0, 9.0), fit(2, 0, 4.0), fit(3, 1, 1e-6), fit(3, 2, 50.0), fit(1, 0, 9.0)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in x.T], names=d.columns)
    called = []
    alone = mixture._statistics
    mixture._statistics = lambda *a: called.append(a[1].restart) or alone(*a)
    try:
        got = mixture._batch_statistics(batch, (layout, fits))
    finally:
        mixture._statistics = alone
    assert called == [1]
    for f, flat in zip(fits, got, strict=True):
        np.testing.assert_allclose(flat, alone(layout, f, layout.read(batch)), rtol=1e-8, atol=1e-8)


def test_shared_statistics_take_two_exponentials_of_a_share(monkeypatch):
    """Shares of classes and of memberships once each, whatever the chunks; the sums are those of one fit at a time."""
    from cohortloom.operators import mixture

    rng = np.random.default_rng(4)
    n, k = 700, 4
    d = mixture.Descriptor(("b",), ("c1", "c2"), ("g",), ((0.0, 1.0, 2.0),), ("z1", "z2"))
    layout = mixture._Layout(d, np.zeros(2), np.zeros(2), np.ones(2))
    z = np.column_stack([np.ones(n), rng.normal(size=(n, 2))])
    parts = (rng.integers(0, 2, (n, 1)).astype(float), rng.normal(size=(n, 2)), np.eye(3)[rng.integers(0, 3, n)], z)
    fits = [
        mixture.MixtureFit(
            k, 0, i, rng.uniform(0.1, 0.9, (k, 1)), rng.normal(size=(k, 2)), rng.uniform(0.5, 2.0, (k, 2)), rng.dirichlet(np.ones(3), k),
            np.vstack([np.zeros(3), rng.normal(size=(k - 1, 3))]), np.full(k, 1 / k),
        )
        for i in range(6)
    ]
    want = [mixture._statistics(layout, f, parts) for f in fits]
    taken, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, **o: taken.append(np.size(x)) or exp(x, **o))
    monkeypatch.setattr(mixture, "_CHUNK_VALUES", 2400)
    got = mixture._sized_statistics(layout, fits, parts)
    assert sum(taken) == 2 * n * k * len(fits)
    for a, b in zip(got, want, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)
