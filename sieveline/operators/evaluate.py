"""The evaluation runners: each returns one tidy table.

`df`: doc, text, label (0, 1), lang, grp (rows that must not be parted), and for transfer also concept. Whatever is fitted is fitted on the rows
named as training rows alone: vocabularies and scales too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators import metrics as M
from sieveline.operators import model as L
from sieveline.operators import perturb as V
from sieveline.operators import splits as S
from sieveline.sources.stored import stash

CV = {
    "logreg (shipped)": {},
    "linear SVC": {"kind": "svc"},
    "random forest": {"kind": "rf"},
    "logreg, signals centred": {"scaler": "standard"},
    "logreg, no normalisation": {"normalise": False},
}
ABLATION = {
    "full": {},
    "no normalisation": {"normalise": False},
    "no entity folding": {"fold": False},
    "no normalisation, no folding": {"normalise": False, "fold": False},
    "char only": {"blocks": ("char",)},
    "word only": {"blocks": ("word",)},
    "char and word": {"blocks": ("char", "word")},
    "signals only": {"blocks": ("signals",)},
    "signals centred": {"scaler": "standard"},
}
RATES = ["precision", "recall", "f1", "fpr", "accuracy"]


def judged(fitted: L.Fitted, df: DataFrame) -> DataFrame:
    """df's columns but text, with score and pred."""
    found = fitted.scored(df.select("doc", "text")).select("doc", "score", (F.col("label") == "scam").cast("int").alias("pred"))
    return df.drop("text").join(found, "doc")


def sliced(pred: DataFrame, *by: str) -> DataFrame:
    """slice ('all', or a value of one of the columns), n and the rates."""
    slices = F.explode(F.array(F.lit("all"), *(F.col(c).cast("string") for c in by)))
    report = M.binary_report(pred.withColumn("slice", slices).filter("slice is not null"), "slice")
    return report.select("slice", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), *RATES)


def union(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df)
    return out


def named(df: DataFrame, **values) -> DataFrame:
    return df.select(*(F.lit(v).alias(k) for k, v in values.items()), *df.columns)


def held_out(train: DataFrame, test: DataFrame, **config) -> tuple[L.Fitted, DataFrame]:
    """The model and the judged test rows."""
    fitted = L.fit(train, **config)
    return fitted, stash(judged(fitted, test))


def cross_validated(df: DataFrame, configs: dict[str, dict] = CV, folds: int = 5, strata: tuple[str, ...] = ("label", "lang")) -> DataFrame:
    """config, slice (all, each language), mean_f1, std_f1 (population) over the folds."""
    rows = stash(df.join(S.group_folds(df, "grp", list(strata), folds), "grp"))

    def each(name: str, config: dict):
        for fold in range(folds):
            pred = held_out(rows.filter(F.col("fold") != fold), rows.filter(F.col("fold") == fold), **config)[1]
            yield named(sliced(pred, "lang"), config=name, fold=fold)

    scores = stash(union(x for name, config in configs.items() for x in each(name, config)))
    return scores.groupBy("config", "slice").agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"), F.count("*").alias("folds"))


def transfer_matrix(df: DataFrame, langs: tuple[str, str], strata: tuple[str, ...] = ("label",), **config) -> DataFrame:
    """train, test, signals, n_train, n and rates, over one split by concept: a translation of a training row is never a test row."""
    train, test = (stash(x) for x in S.group_split(df, "concept", list(strata)))
    if not S.leaked(train, test, "concept").isEmpty():
        raise RuntimeError("a concept is on both sides")
    blocks = tuple(config.pop("blocks", ("char", "word", "signals")))
    plain = tuple(b for b in blocks if b != "signals")
    of = lambda rows, lang: rows if lang == "joint" else rows.filter(F.col("lang") == lang)

    def each():
        for source in (*langs, "joint"):
            for used in [blocks] + [plain] * (source != "joint" and plain not in ((), blocks)):
                own = of(train, source)
                fitted, n = L.fit(own, blocks=used, **config), own.count()
                for target in langs:
                    yield named(sliced(judged(fitted, of(test, target))).drop("slice"), train=source, test=target, signals="signals" in used, n_train=n)

    return union(each())


def ablation(train: DataFrame, test: DataFrame, configs: dict[str, dict] = ABLATION) -> DataFrame:
    """config, slice, n and rates."""
    return union(named(sliced(held_out(train, test, **config)[1], "lang"), config=name) for name, config in configs.items())


def robustness(fitted: L.Fitted, test: DataFrame) -> DataFrame:
    """variant, f1, recall, fpr and the drop of f1 against `none`: both classes are evaded, as recall alone would mislead."""
    variants = V.evaded(test.select("doc", "text"), "doc").select(F.concat_ws("|", "variant", F.col("doc").cast("string")).alias("key"), "doc", "variant", F.col("evaded").alias("text"))
    variants = stash(variants)
    pred = judged(fitted, variants.select(F.col("key").alias("doc"), "text")).withColumnRenamed("doc", "key")
    both = variants.drop("text").join(pred, "key").join(test.select("doc", "label"), "doc")
    return M.against_baseline(M.binary_report(both, "variant").select("variant", "f1", "recall", "fpr"), "variant", "none")


def under_shift(train: DataFrame, test: DataFrame, **config) -> DataFrame:
    """normalise, clean_f1, shifted_f1, delta: training as it is, the test rows clean and in a spelling that training never saw."""
    moved = test.withColumn("text", V.shifted(F.col("text"), F.col("doc").cast("string")))

    def each(normalise: bool) -> DataFrame:
        fitted = L.fit(train, normalise=normalise, **config)
        f1 = lambda rows, name: sliced(judged(fitted, rows)).select(F.col("f1").alias(name))
        both = f1(test, "clean_f1").crossJoin(F.broadcast(f1(moved, "shifted_f1")))  # one row each
        return named(both.withColumn("delta", F.col("shifted_f1") - F.col("clean_f1")), normalise=normalise)

    return union(map(each, (True, False)))


def collected(df: DataFrame, **config) -> DataFrame | None:
    """The class report of collected rows by a model of the authored ones, which are never blended; None if nothing was collected."""
    rows = df.filter("source = 'collected'")
    if rows.isEmpty():
        return None
    return M.class_report(held_out(df.filter("source = 'authored'"), rows, **config)[1], [0, 1])


def run(df: DataFrame, langs: tuple[str, str] = ("ar", "ckb"), skip: tuple[str, ...] = (), collected_only: bool = False, configs: dict[str, dict] = CV, **config) -> dict[str, DataFrame]:
    """All tables by name. skip: of heldout, transfer, ablation and adversarial; collected_only: on collected rows alone."""
    if collected_only:
        df = df.filter("source = 'collected'")
        if df.isEmpty():
            raise ValueError("no collected rows; nothing to evaluate")
    train, test = (stash(x) for x in S.group_split(df, "grp", ["label", "lang"]))
    out: dict[str, DataFrame] = {}
    runners: dict[str, Callable[[], dict[str, DataFrame]]] = {
        "transfer": lambda: {"transfer": transfer_matrix(df, langs, **config)},
        "ablation": lambda: {"ablation": ablation(train, test), "shift": under_shift(train, test, **config)},
    }
    fitted = None
    if "heldout" not in skip:
        fitted, pred = held_out(train, test, **config)
        out |= {"heldout": M.class_report(pred, [0, 1]), "confusion": M.confusion(pred, [0, 1]), "average_precision": M.average_precision(pred), "slices": sliced(pred, "lang"), "cv": cross_validated(df, configs)}
    for name, runner in runners.items():
        if name not in skip:
            out |= runner()
    if "adversarial" not in skip:
        out["robustness"] = robustness(fitted or L.fit(train, **config), test)
    if "source" in df.columns and (found := collected(df, **config)) is not None:
        out["collected"] = found
    return out
