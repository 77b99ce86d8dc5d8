"""Stages whose results are written and reused while their inputs and parameters stay the same."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import schemas
from lexmill.functions import vector as vx
from lexmill.operators import annotate, corpus, dedup, pairs, plugins, retrieval, sample, subword, tfidf
from lexmill.session import materialize
from lexmill.sources import files


@dataclass
class Stage:
    """``run(spark, inputs, **params)`` gives a DataFrame; ``needs`` names the stages whose tables it reads."""

    name: str
    run: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)


class Pipeline:
    """Runs stages in order below a work folder; a stage whose manifest matches is read instead of run."""

    def __init__(self, spark: SparkSession, workdir: str, sources: dict[str, str]) -> None:
        self.spark, self.workdir, self.sources = spark, workdir.rstrip("/"), sources
        self.tables: dict[str, DataFrame] = {name: spark.read.parquet(path) for name, path in sources.items()}
        self.prints: dict[str, str] = {name: self._source_print(path) for name, path in sources.items()}
        self.ran: list[str] = []

    def _source_print(self, path: str) -> str:
        """Names, sizes and times of the source's files, wherever they lie."""
        return files.fingerprint(self.spark, path)

    def _manifest(self, stage: Stage) -> dict:
        return {"stage": stage.name, "params": stage.params, "inputs": {n: self.prints[n] for n in stage.needs}, "code": code_version()}

    def run(self, stages: list[Stage]) -> dict[str, DataFrame]:
        for stage in stages:
            manifest = self._manifest(stage)
            mark = hashlib.sha1(json.dumps(manifest, sort_keys=True).encode()).hexdigest()
            place = f"{self.workdir}/{stage.name}/{mark}"
            if not files.exists(self.spark, f"{place}.json"):
                stage.run(self.spark, {n: self.tables[n] for n in stage.needs}, **stage.params).write.mode("overwrite").parquet(place)
                files.write_small(self.spark, f"{place}.json", json.dumps(manifest, indent=2, sort_keys=True))
                self.ran.append(stage.name)
            self.tables[stage.name], self.prints[stage.name] = self.spark.read.parquet(place), mark
        return self.tables


@functools.cache
def code_version() -> str:
    """Changes with the source of this package."""
    root = Path(__file__).resolve().parents[1]
    return hashlib.sha1(b"".join(p.read_bytes() for p in sorted(root.rglob("*.py")) if "llm" not in p.relative_to(root).parts)).hexdigest()


def corpus_stage(spark: SparkSession, t: dict[str, DataFrame], threshold: float = 0.8, exact: bool = True) -> DataFrame:
    """Lines -> near-duplicates removed -> leaked lines removed, with a line number over the whole corpus."""
    lines = corpus.corpus_lines(t["documents"])
    keyed = corpus.first_of_equal(lines, "doc_id", "pos").withColumn("line", F.concat_ws(":", F.lpad(F.col("doc_id").cast("string"), 19, "0"), F.lpad(F.col("pos").cast("string"), 10, "0")))
    kept = dedup.dedup(keyed.select("line", "text"), "line", "text", threshold=threshold, exact=exact)
    return corpus.without_leaks(kept, t["en_sts_test"])


def embed_stage(spark: SparkSession, t: dict[str, DataFrame], dim: int = 64) -> DataFrame:
    return plugins.encode(t["corpus"], plugins.HashedWords(dim)).select("line", "text", "embedding")


def evaluate(sts: DataFrame, encoder: plugins.Encoder, branch: str = "a", k: int = 10) -> DataFrame:
    """(branch, metric, value): Spearman of cosine and score, Recall@k and MRR@k of sentence_a against all sentence_b."""
    own = sts.filter("sentence_a is not null and sentence_b is not null").select("id", "sentence_a", "sentence_b", "score")
    a = plugins.encode(own, encoder, "sentence_a").withColumnRenamed("embedding", "va")
    both = plugins.encode(a, encoder, "sentence_b").withColumnRenamed("embedding", "vb")
    both = materialize(both.withColumn("cosine", vx.cosine("va", "vb")), "encoded")
    rho = retrieval.spearman(both, "cosine", "score").select(F.lit(branch).alias("branch"), F.lit("spearman").alias("metric"), F.col("rho").alias("value"))
    # documents get names of their own, so that a query may find the document of its own row
    queries = both.select((-F.col("id") - 1).cast("long").alias("q"), F.col("va").alias("v"), F.col("id").cast("long").alias("positive"))
    docs = both.select(F.col("id").cast("long").alias("doc"), F.col("vb").alias("v"))
    return rho.unionByName(retrieval.recall_mrr(retrieval.positive_ranks(queries, docs, k), k, branch))


def evaluate_branches(sts: DataFrame, branches: dict[str, plugins.Encoder | None], training: list[DataFrame] | None = None, k: int = 10) -> DataFrame:
    """(branch, metric, value) of several encoders; a missing one (None) is skipped.

    First the guard: no sentence of the evaluation set may stand in a training text (path, text).
    """
    for texts in training or []:
        corpus.require_clean_files(texts, sts)
    out = None
    for name, encoder in branches.items():
        if encoder is not None:
            part = evaluate(sts, encoder, name, k)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else sts.sparkSession.createDataFrame([], schemas.METRICS)


def silver_set(
    lines: DataFrame, providers: list[plugins.Translator], pivot: str, source: str, cache: DataFrame, n: int = 300, seed: int = 42, delay: float = 0.0, cache_path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(sentence_a, sentence_b, score) in three silver tiers, and (score, n), the size of each tier.

    Only the lines of the upper tier's sample are translated, with some to spare for failures.
    """
    asked = sample.sample_rows(lines.select("text").distinct(), 2 * max(1, n // 3), f"{seed}t", "text")
    paraphrases, _ = plugins.back_translate(asked, providers, pivot, source, cache, delay=delay, cache_path=cache_path)
    made = materialize(pairs.silver_pairs(lines, n, seed, paraphrases), "silver")
    return made, made.groupBy("score").agg(F.count("*").alias("n"))


def svd_pairs(lines: DataFrame, n: int, k: int = 100, seed: int = 42) -> DataFrame:
    """(pair, sentence_a, sentence_b, score): random pairs of lines(doc_id, pos, text), scored by their latent similarity."""
    keyed = sample.numbered(lines.select("doc_id", "pos", "text"), "doc_id", "pos").select(F.col("idx").alias("doc_id"), "text")
    keyed = materialize(keyed, "lines")
    scored = tfidf.lsa_scored_pairs(keyed, n, k=k, seed=seed)
    a = keyed.select(F.col("doc_id").alias("i"), F.col("text").alias("sentence_a"))
    b = keyed.select(F.col("doc_id").alias("j"), F.col("text").alias("sentence_b"))
    return scored.join(a, "i").join(b, "j").select("pair", "sentence_a", "sentence_b", "score")


def svd_evaluation(lines: DataFrame, branches: dict[str, plugins.Encoder | None], n: int = 3000, components: int = 100, k: int = 5, scale: float = 5.0, metrics_path: str | None = None) -> DataFrame:
    """Metrics of encoders on an evaluation set that is labelled by latent similarity; no people and no services needed."""
    labelled = materialize(svd_pairs(lines, n, components), "svd")
    sts = labelled.select(F.col("pair").alias("id"), "sentence_a", "sentence_b", (F.col("score") / scale).alias("score"))
    metrics = evaluate_branches(sts, branches, k=k)
    if metrics_path is not None:
        files.write_metrics(metrics, metrics_path)
    return metrics


def seed_items(lines: DataFrame, encoder: plugins.Encoder, n: int = 60, n_random: int = 400, max_reuse: int = 2, seed: int = 42, most_lines: int = 5000) -> DataFrame:
    """(pair, sentence_a, sentence_b, uncertainty, status, gold_label): the n most uncertain pairs of lines for people to label.

    A bounded sample of the lines, in their order, gives neighbours and random pairs; of these the most uncertain by the
    encoder are taken, no sentence more often than ``max_reuse``.
    """
    pool = sample.sample_rows(lines.select("doc_id", "pos", "text"), most_lines, seed, "doc_id", "pos")
    pool = materialize(sample.numbered(pool, "doc_id", "pos").select("idx", "text"), "pool")
    near = pool.join(pool.select((F.col("idx") - 1).alias("idx"), F.col("text").alias("b")), "idx").select(F.col("idx").alias("pair"), F.col("text").alias("a"), "b")
    far = sample.random_pairs(pool, n_random, seed, "idx").select((F.col("pair") + most_lines).alias("pair"), "a", "b")
    vectors = materialize(plugins.encode(pool.select("text").distinct(), encoder, unit=False), "vectors")
    both = near.unionByName(far)
    for side in ("a", "b"):
        both = both.join(vectors.select(F.col("text").alias(side), F.col("embedding").alias(f"v{side}")), side)
    scored = pairs.scored_uncertainty(both).select("pair", "a", "b", F.col("uncertainty").alias("score"))
    chosen = pairs.select_capped(materialize(scored, "scored"), n, max_reuse)
    return chosen.select("pair", F.col("a").alias("sentence_a"), F.col("b").alias("sentence_b"), F.col("score").alias("uncertainty"), F.lit("pending").alias("status"), F.lit(None).cast("double").alias("gold_label"))


def triplet_stage(spark: SparkSession, t: dict[str, DataFrame], upper: float = 0.7, lower: float = 0.3) -> DataFrame:
    return annotate.percentile_triplets(annotate.labelled_pairs(t["items"], t["annotations"]), upper, lower)


def export_triplets(triplets: DataFrame, path: str) -> int:
    return files.write_jsonl(triplets, path, schemas.TRIPLET)


DEFAULT = [
    Stage("corpus", corpus_stage, ("documents", "en_sts_test"), {"threshold": 0.8}),
    Stage("embeddings", embed_stage, ("corpus",), {"dim": 64}),
    Stage("triplets", triplet_stage, ("items", "annotations"), {"upper": 0.7, "lower": 0.3}),
]


def gate_stage(spark: SparkSession, t: dict[str, DataFrame], most_unknown: float = 0.01) -> DataFrame:
    """The diagnostics of the tokenizer on the documents; an error if it leaves too much unknown."""
    diagnostics = materialize(subword.tokenizer_diagnostics(t["documents"]), "diagnostics")
    subword.require_coverage(diagnostics, most_unknown)
    return diagnostics


def evaluation_stage(spark: SparkSession, t: dict[str, DataFrame], dim: int = 256, k: int = 10) -> DataFrame:
    sts = t["en_sts_test"].select(F.col("test_id").alias("id"), "sentence_a", "sentence_b", (F.col("score") / 5).alias("score"))
    return evaluate_branches(sts, {"a": plugins.HashedWords(dim)}, [t["corpus"].select(F.lit("corpus").alias("path"), "text")], k)


FULL = [Stage("tokenizer", gate_stage, ("documents",), {"most_unknown": 0.01}), *DEFAULT, Stage("evaluation", evaluation_stage, ("corpus", "en_sts_test"), {"dim": 256, "k": 10})]


def main(argv: list[str] | None = None) -> list[str]:
    """Runs the stages over a folder of tables: ``python -m lexmill.plans.pipeline --tables DIR --work DIR [--export DIR]``."""
    import argparse

    from lexmill.session import build_session, ship_package

    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("--tables", required=True, help="folder of documents, en_sts_test, items and annotations")
    parser.add_argument("--work", required=True, help="folder for the stages' tables and manifests")
    parser.add_argument("--export", help="folder for corpus lines, triplets and metrics as files")
    parser.add_argument("--stages", default=",".join(s.name for s in FULL))
    options = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or build_session()
    ship_package(spark)
    names = ("documents", "en_sts_test", "items", "annotations")
    pipe = Pipeline(spark, options.work, {n: f"{options.tables.rstrip('/')}/{n}.parquet" for n in names})
    tables = pipe.run([s for s in FULL if s.name in options.stages.split(",")])
    if options.export:
        if "corpus" in tables:
            files.write_corpus(tables["corpus"], f"{options.export}/corpus", ("line",))
        if "triplets" in tables:
            export_triplets(tables["triplets"], f"{options.export}/triplets")
        if "evaluation" in tables:
            files.write_metrics(tables["evaluation"], f"{options.export}/metrics.json")
    return pipe.ran


def triplets_by(method: str, lines: DataFrame, items: DataFrame, annotations: DataFrame, n: int | None = None, seed: int = 1337, paraphrases: DataFrame | None = None, k: int = 100) -> DataFrame:
    """Triplets from silver or human labels: ``svd`` (latent similarity of random pairs of lines),
    ``backtranslation`` (three silver tiers) or ``native`` (mean human labels).  An error if there are none.

    ``lines`` is (doc_id, pos, text).  Training uses another seed than evaluation sets, whose default is 42.
    """
    if method == "svd":
        labelled = svd_pairs(lines, n or 3000, k, seed).withColumnRenamed("pair", "item_id")
    elif method == "backtranslation":
        silver = pairs.silver_pairs(lines, n or 300, seed, paraphrases)
        labelled = silver.withColumn("item_id", F.xxhash64("sentence_a", "sentence_b"))
    elif method == "native":
        labelled = sample.sample_rows(annotate.labelled_pairs(items, annotations), n or 60, seed, "item_id")
    else:
        raise ValueError(f"unknown labelling method {method}")
    out = materialize(annotate.percentile_triplets(labelled, seed=seed), "triplets")
    if out.isEmpty():
        raise ValueError(f"labelling by {method} gave no triplets")
    return out


if __name__ == "__main__":
    main()
