"""What the operators of this subpackage share: words, hashes, Arrow batches, checkpoints and sized broadcasts."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import materialise  # noqa: F401: the operators take it from here

WORD = re.compile(r"\w+")
#: Entries that a worker's word table holds before it is emptied; a bound on memory alone, results don't depend on it.
CACHE_WORDS = 250_000
#: Rows of a key table that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 2_000_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores; none in a null text."""
    return WORD.findall(text.lower()) if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


class WordHash(dict):
    """Word to 64-bit hash; each distinct word is hashed once a worker."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def array(self, found: list[str]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, in order; none where there are fewer than n words."""
    m = len(h) - n + 1
    if m <= 0:
        return h[:0]
    acc = h[:m]
    for i in range(1, n):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m]
    return mix64(acc)


def tune_arrow(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of very long texts must fit beside others in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16777216")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_keys(df: DataFrame, keys: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of df whose column isn't among keys (one column of that name); nulls stay. Broadcasts keys only below BROADCAST_ROWS."""
    return df.join(sized(keys), column, "left_anti")


def sized(keys: DataFrame) -> DataFrame:
    """A table of few columns, as it is, or marked for broadcast if it has been counted and has at most BROADCAST_ROWS."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Just the key and the text, whatever else docs holds."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
