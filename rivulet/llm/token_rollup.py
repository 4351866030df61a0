"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A batch of changes holds signed deltas: an inserted document adds its tokens and one document to its group, a deleted one
subtracts both, a revised count adds the difference (a document that changes its group is a deletion and an
insertion). A batch is summed by group and committed as one table under its name in the rollup's folder; totals are the
sums over committed batches, so they never need the documents again.

A commit is idempotent: a batch is written aside and renamed to its name in one step, which fails if the name is taken,
so of several commits of one name exactly one counts and none is ever half there. (The folder's file system must rename
atomically, as HDFS does.) compact() replaces the committed batches by one table, put in place in the same way, that
remembers their names, so that a late repetition still changes nothing; tables that it takes in are deleted by the
compaction after it, so that readers can end.

Tokens are counted by byte-level BPE with a given vocabulary file; the driver reads it and broadcasts its ranks (their
number is fixed by the file). Counts are of whole texts. Runs of 4096 and more white space are counted apart, cut off
where the vocabulary's pattern cuts them: the pattern's matcher would need a stack as deep as such a run is long.

Defined cases: null and empty texts have no tokens but count as documents; null source or lang is a group of its own;
repeated rows count each; groups of no documents and no tokens are left out of the totals; an empty batch commits.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import checkpoint, id_text, shared_folder

#: How byte-level BPE of this vocabulary cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: What the pattern's \s stands for.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
GROUP = ("source", "lang", "tokenizer")
DELTAS = "source string, lang string, tokenizer string, documents long, tokens long"


@lru_cache(maxsize=4)
def _encoding(ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def count(encoding, text: str) -> int:
    """The number of text's tokens.

    A run of white space is one piece, but for its last character if more text follows; no piece goes on into a run.
    """
    n = at = 0
    for run in _WHITE.finditer(text):
        end = run.end() - (run.end() < len(text))
        n += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return n + len(encoding.encode_ordinary(text[at:]))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """The columns of docs but text, and tokens: the number of tokens of each text."""
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))
    out = docs.select(*(F.col(f"`{c}`") for c in kept)).schema.add("tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks.value)
        for batch in batches:
            counts = pa.array([count(encoding, t.as_py()) for t in batch.column(len(kept))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], names=[*kept, "tokens"])

    return rows.mapInArrow(run, out)


def inserts(counted: DataFrame) -> DataFrame:
    """Deltas of new documents: source, lang, tokenizer, tokens."""
    return _deltas(counted, 1, F.col("tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    """Deltas of documents that are gone, with the counts that they had."""
    return _deltas(counted, -1, -F.col("tokens"))


def revisions(counted: DataFrame) -> DataFrame:
    """Deltas of documents that stay in their groups: old_tokens and tokens."""
    return _deltas(counted, 0, F.col("tokens") - F.col("old_tokens"))


def _deltas(counted: DataFrame, documents: int, tokens) -> DataFrame:
    return counted.select(*(F.col(c).cast("string").alias(c) for c in GROUP), F.lit(documents).cast("long").alias("documents"), tokens.cast("long").alias("tokens"))


class Rollup:
    """Additive totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join((self.path, *parts)))

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at())] if self._fs.exists(self._at()) else []

    def _bases(self) -> list[str]:
        """Compacted tables, the newest last."""
        return sorted((n for n in self._names() if n.startswith("base=")), key=lambda n: int(n.removeprefix("base=")))

    def _taken(self, base: str) -> set[str]:
        return {r["name"] for r in self.spark.read.schema("name string").parquet(f"{self.path}/{base}/names").collect()}

    def committed(self) -> list[str]:
        """Tables that count: the newest base, and batches that it has not taken in."""
        bases = self._bases()[-1:]
        gone = self._taken(bases[0]) if bases else set()
        return [*bases, *sorted(n for n in self._names() if n.startswith("batch=") and n not in gone)]

    def _publish(self, written: str, name: str) -> bool:
        """Renames a whole table; False if the name is taken."""
        conf = self.spark._jsc.hadoopConfiguration()
        context = self._hadoop.FileContext.getFileContext(self._at().toUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._at(written), self._at(name), none)
        except Py4JJavaError as e:
            self._fs.delete(self._at(written), True)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
                return False
            raise
        return True

    def _known(self, name: str) -> bool:
        bases = self._bases()[-1:]
        return self._fs.exists(self._at(name)) or bool(bases) and name in self._taken(bases[0])

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch of signed deltas; False if it was committed before."""
        name = f"batch={batch}"
        if self._known(name):
            return False
        written = f"_written-{uuid.uuid4().hex}"
        deltas.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.path}/{written}")
        return self._publish(written, name)

    def _sums(self, tables: list[str]) -> DataFrame:
        parts = [f"{self.path}/{n}/data" if n.startswith("base=") else f"{self.path}/{n}" for n in tables]
        rows = self.spark.read.schema(DELTAS).parquet(*parts) if parts else self.spark.createDataFrame([], DELTAS)
        return rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens over all committed batches."""
        return self._sums(self.committed()).where("documents <> 0 OR tokens <> 0")

    def compact(self) -> bool:
        """Replaces the committed batches by one table; False if another compaction was first."""
        bases, tables = self._bases(), self.committed()
        before = self._taken(bases[-1]) if bases else set()
        taken = sorted(before | {n for n in tables if n.startswith("batch=")})
        base, written = f"base={1 + int(bases[-1].removeprefix('base=')) if bases else 1}", f"_written-{uuid.uuid4().hex}"
        self._sums(tables).write.parquet(f"{self.path}/{written}/data")
        self.spark.createDataFrame([(n,) for n in taken], "name string").coalesce(1).write.parquet(f"{self.path}/{written}/names")
        if not self._publish(written, base):
            return False
        for n in (*bases[:-1], *(n for n in self._names() if n in before)):
            self._fs.delete(self._at(n), True)
        return True


#: The group that documents count for until their language is known.
NO_LANG = "to be identified"


def history(counted: DataFrame) -> dict[str, DataFrame]:
    """A history in batches after which the documents' totals are those of counted.

    counted: source, lang, tokenizer, tokens, words, turn (0 to 3 for each document). All are loaded, but those of turn 1
    with their number of words in place of tokens, which is revised then, and those of turn 2 under no language yet, from
    which they move to theirs; those of turn 3 are deleted and inserted again.
    """
    known = F.when(F.col("turn") == 2, F.lit(NO_LANG)).otherwise(F.col("lang"))
    guessed = F.when(F.col("turn") == 1, F.col("words")).otherwise(F.col("tokens"))
    loaded = counted.withColumns({"lang": known, "tokens": guessed})
    of = lambda rows, turn: rows.where(F.col("turn") == turn)
    return {
        "load": inserts(loaded),
        "revise": revisions(of(counted, 1).withColumn("old_tokens", F.col("words"))),
        "move": deletes(of(loaded, 2)).union(inserts(of(counted, 2))),
        "delete": deletes(of(counted, 3)),
        "insert again": inserts(of(counted, 3)),
    }


def roll_up(docs: DataFrame, vocabulary: str = VOCABULARY, version: str = "byte_bpe_50k") -> DataFrame:
    """Totals over all docs after the batches of their history, each committed twice, with a compaction on the way.

    Texts are counted once; the counts, a few numbers for each document, are what batches are made of.
    """
    rollup = Rollup(docs.sparkSession, f"{shared_folder(docs.sparkSession)}/rollup-{uuid.uuid4().hex}")
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    turn = F.pmod(F.xxhash64(F.lit("turn"), id_text(F.col("doc_id"))), F.lit(4))
    counted = checkpoint(count_tokens(docs.select("source", "lang", words.alias("words"), turn.alias("turn"), "text"), vocabulary).withColumn("tokenizer", F.lit(version)))
    for k, (name, deltas) in enumerate(history(counted).items()):
        for _ in range(2):
            rollup.commit(name, deltas)
        if k == 1:
            rollup.compact()
    return rollup.totals()
