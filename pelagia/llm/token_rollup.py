"""Token counts: rollups by source, language and tokenizer version, kept by signed deltas in idempotent batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.shared import word_count

KEY = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, docs long, tokens long, changes long"
CHANGE_KINDS = ("insert", "delete", "revise")


def tokenizers(text: Column) -> dict[str, Column]:
    """Versions that need no model: words, and words with each ASCII punctuation mark as a token of its own."""
    words = word_count(text)
    marks = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[!-/:-@\[-`{-~]")).cast("long")
    return {"words/1": words, "words_marks/1": words + marks}


def counted(docs: DataFrame, versions: dict[str, Column] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, source, lang, tokenizer, tokens): the count of every whole text by every version, from one scan.

    ``versions`` maps a version to a column that counts; null texts count as empty, null sources and languages are
    groups of their own.
    """
    versions = versions or tokenizers(F.col(text_col))
    each = F.array(*[F.struct(F.lit(v).alias("tokenizer"), c.cast("long").alias("tokens")) for v, c in versions.items()])
    return docs.select(F.col(id_col).alias("id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.explode(each).alias("c")).select("id", "source", "lang", "c.*")


def change(rows: DataFrame, kind: str, before: Column | None = None) -> DataFrame:
    """Change rows (source, lang, tokenizer, kind, tokens, before) from counts; ``before`` is the count a revision replaces."""
    if kind not in CHANGE_KINDS:
        raise ValueError(f"a change is one of {CHANGE_KINDS}")
    return rows.select(*KEY, F.lit(kind).alias("kind"), "tokens", (before if before is not None else F.lit(None)).cast("long").alias("before"))


def deltas(changes: DataFrame) -> DataFrame:
    """Additive totals of a batch of changes: +1 document and +n tokens, -1 and -n, or 0 and new - old.

    A null count adds nothing. Summed in partial aggregates, so a hot source sends one row a task.
    """
    n, old = F.coalesce("tokens", F.lit(0)), F.coalesce("before", F.lit(0))
    sign = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).otherwise(0)
    moved = F.when(F.col("kind") == "revise", n - old).otherwise(sign * n)
    return changes.groupBy(*KEY).agg(F.sum(sign).cast("long").alias("docs"), F.sum(moved).cast("long").alias("tokens"), F.count(F.lit(1)).alias("changes"))


class Rollup:
    """A folder of committed delta batches; totals are their sum.

    A batch is one sub-folder, complete once Spark has put its ``_SUCCESS`` there. Committing a number that is complete
    changes nothing, and an incomplete one (its job was lost) is written anew, so a batch can be sent any number of
    times. ``fold`` adds up all batches to a number into one, under the same rule: a batch of the folded range is read
    from the fold only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _complete(self, prefix: str) -> list[int]:
        path, fs = self._folder("")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        numbers = [int(n[len(prefix):]) for n in names if n.startswith(prefix)]
        done = lambda n: (lambda p, f: f.exists(p))(*self._folder(f"{prefix}{n}/_SUCCESS"))
        return sorted(n for n in numbers if done(n))

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Write the deltas of a batch; False if it is committed already."""
        if batch in self._complete("batch-") or batch <= max(self._complete("fold-"), default=-1):
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")
        return True

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*[f"{self.path}/{n}" for n in names])

    def _current(self) -> list[str]:
        folded = max(self._complete("fold-"), default=-1)
        return [f"fold-{folded}"] * (folded >= 0) + [f"batch-{n}" for n in self._complete("batch-") if n > folded]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens): the sums of all committed batches; groups of nothing are left out."""
        summed = self._read(self._current()).groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.filter("docs <> 0 or tokens <> 0")

    def fold(self, to: int) -> None:
        """Replace the batches up to ``to`` by their sum; safe to repeat."""
        if to <= max(self._complete("fold-"), default=-1):
            return
        names = [n for n in self._current() if n.startswith("fold-") or int(n.split("-")[1]) <= to]
        rows = self._read(names).groupBy(*KEY).agg(*[F.sum(c).cast("long").alias(c) for c in ("docs", "tokens", "changes")])
        rows.write.mode("overwrite").parquet(f"{self.path}/fold-{to}")
