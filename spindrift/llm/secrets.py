"""Secrets in texts, by novelty against what surrounds them.

A candidate is a run of key characters in a sensitive context: assigned to a name such as token or password, or with a known
prefix of its own; a quoted or bare value of any characters that such a name is given; the password within a URL; or all
lines of a private key, from its header to its end. Its novelty is its marginal size: the bytes that zstandard needs for
context and candidate, less those for the context alone, with a dictionary primed with the corpus's identifiers
and words. A word or a name that the corpus or the surroundings know compresses to little; a key doesn't, and is reported.

The identifiers are counted over all documents. Only whole ones without digits count, of at most 24 characters, so that
no part of a key that is repeated in many copies gets into the dictionary; nor does the candidate itself into its context.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialise, read_table, texts, tune_arrow

#: Bytes of the primed dictionary, and words that a task counts before it passes the counts on.
DICTIONARY_BYTES = 64_000
COUNTED_WORDS = 400_000
BEFORE, AFTER = 160, 80
#: Marginal bytes that a secret has at least, in all and as a share of what random characters of its alphabet hold.
MIN_BYTES, MIN_SHARE = 9, 0.9
NAME_SHARE, FEW_DIGITS = 0.75, 0.1
#: Marginal bytes of a password that its place in a URL gives away.
URL_BYTES = 6
MASK = "[SECRET]"

IDENTIFIER = re.compile(r"[^\W\d]{4,24}")
_NAMES = ["token", "secret", "passw", "pwd", "api_key", "apikey", "api-key", "access_key", "accesskey", "auth", "credential", "bearer", "private_key", "client_key", "private key-----"]
#: Of each alternative of CANDIDATE's names, the part that all its spellings share.
_STEMS = ["://", "token", "secret", "passw", "pwd", "apikey", "api_key", "api-key", "access", "auth", "credential", "bearer", "private", "client"]
_PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "sk_test_", "xox", "AIza", "eyJ", "npm_", "hf_"]
_PREFIX = re.compile("|".join(map(re.escape, _PREFIXES)))
#: Breaks within keys and what joins their parts; and small alphabets by their sizes.
_NO_KEY = re.compile(r"\\[rn]|[\s_.=\-]")
_ALPHABETS = [(10, re.compile(r"\d+")), (16, re.compile(r"[\da-f]+|[\dA-F]+")), (32, re.compile(r"[A-Z2-7]+")), (36, re.compile(r"[a-z\d]+|[A-Z\d]+"))]
_KEY = r"[A-Za-z0-9+/_\-]"
#: Ahead of a value of any characters: letters, a digit and something else, as passwords have and prose hasn't.
_MIXED = r"(?=[^\s\"']{0,199}?[A-Za-z])(?=[^\s\"']{0,199}?\d)(?=[^\s\"']{0,199}?[^\w\s\"'.,:;/\-])"
_BREAKS = re.compile(r"\\[rn]|\s+")
_BREAK, _BLOCK = r"(?:\s|\\[rn])", "[A-Za-z0-9+/]"
CANDIDATE = re.compile(
    rf"""(?:
        (?i:private\ key(?:\ block)?-----){_BREAK}*+
        (?:[A-Za-z][A-Za-z\-]*+:(?:(?!\\[rn])[^\n])*+{_BREAK}++)*
        (?P<p>{_BLOCK}(?:[A-Za-z0-9+/=\s]|\\[rn])*?(?={_BREAK}*+-----\ ?END)
            | {_BLOCK}{{12,}}={{0,2}}(?:{_BREAK}{{1,4}}{_BLOCK}{{16,}}={{0,2}})*(?:{_BREAK}{{1,4}}{_BLOCK}{{1,15}}={{1,2}})?)
      | (?i:[\w\-]{{0,40}}(?:token|secret|passw(?:or)?d|passwd|pwd|api[_\-]?key|access[_\-]?key|auth(?:orization)?|credentials?|private[_\-]?key|client[_\-]?key)[\w\-]{{0,20}}["']?\s{{0,3}}(?:=>|:=|=|:)\s{{0,3}}(?:bearer\s{{1,3}})?["']?
         | \bbearer\s{{1,3}} | private\ key-----\s{{0,4}})
        (?:(?<=["'])(?P<q>{_MIXED}[^\s"']{{9,200}}+)(?=["'])
         | (?P<a>{_KEY}{{12,}}(?:\.{_KEY}{{8,}})*={{0,2}})
         | (?![^\s@]{{0,100}}@[\w\-]{{1,60}}\.\w | \S{{0,200}}://){_MIXED}(?P<r>[^\s"'<>(){{}}\[\],;]{{10,200}}+))
      | (?<![A-Za-z0-9+.\-])[A-Za-z][A-Za-z0-9+.\-]{{1,20}}+://[^\s:/@?\#"'<>]{{0,80}}+:(?P<u>(?=[A-Za-z]*+[^\s/@"'<>])[^\s/@"'<>]{{6,200}}+)@
      | (?<![A-Za-z0-9_])(?P<b>(?:AKIA|ASIA|gh[pos]_|github_pat_|glpat-|sk-|sk_live_|sk_test_|xox[abprs]-|AIza|eyJ|npm_|hf_){_KEY}{{12,}}(?:\.{_KEY}{{8,}})*={{0,2}})
    )""",
    re.VERBOSE,
)


def may_hold(text: str) -> bool:
    """Whether any candidate is possible at all; quick. Every match of CANDIDATE holds one of the stems or prefixes."""
    low = text.lower()
    if not low.isascii():  # letters that patterns without case take for ASCII ones
        low = low.replace("ſ", "s").replace("ı", "i").replace("i̇", "i")
    return any(n in low for n in _STEMS) or any(p in text for p in _PREFIXES)


def corpus_identifiers(docs: DataFrame) -> DataFrame:
    """(word, n): how often each identifier occurs, over all texts. Counted within tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def send() -> pa.RecordBatch:
            own = {w: n for w, n in seen.items() if IDENTIFIER.fullmatch(w)}
            return pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    seen.update(WORD.findall(t.as_py()))
            if len(seen) > COUNTED_WORDS:
                yield send()
                seen.clear()
        yield send()

    tune_arrow(docs.sparkSession)
    return texts(docs).select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def primed_dictionary(docs: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """The identifiers that save the most bytes, as many as fit, the best last, where references are shortest."""
    counts = materialise(corpus_identifiers(docs).where("n > 1")).withColumn("gain", F.col("n") * (F.length("word") - 3))
    # Only words above the level at which the dictionary is full are sorted and sent: a few times its size, however many
    # partitions there are.
    level = F.floor(F.log2("gain") * 4)
    cut, full = 0, 0
    for r in counts.groupBy(level.alias("level")).agg(F.sum(F.octet_length("word") + 1).alias("bytes")).orderBy(F.desc("level")).collect():
        cut, full = r.level, full + r.bytes
        if full > size:
            break
    best = counts.where(level >= cut).orderBy(F.col("gain").desc(), "word").limit(size // 5).collect()
    kept, used = [], 0
    for r in best:
        used += len(r.word.encode()) + 1
        if used > size:
            break
        kept.append(r.word)
    names = " ".join([*_NAMES, "password", "key =", 'token = "', "null", "none", "undefined", "example", "changeme", "placeholder"])
    return (" ".join(reversed(kept)) + " " + names).encode()


def least_bytes(candidate: str) -> float:
    """MIN_SHARE of the bytes of as many random characters of the candidate's alphabet, or NAME_SHARE of a byte for each
    character of what may be a name: one of letters with few digits. Long literals are coded by their frequencies, so hex
    tends to half a byte a character, and decimals to less."""
    core = _NO_KEY.sub("", _PREFIX.sub("", candidate))
    if sum(map(str.isdigit, core)) < FEW_DIGITS * len(core):
        return NAME_SHARE * len(candidate)
    size = next((n for n, alphabet in _ALPHABETS if alphabet.fullmatch(core)), 64)
    return min(NAME_SHARE * len(candidate), MIN_SHARE * len(core) * math.log2(size) / 8)


def _after(text: str, cand: str, at: int, need: int = AFTER) -> str:
    """The next characters that aren't of copies of the candidate; no more of the text is read than that takes."""
    parts = []
    while (j := text.find(cand, at, at + need + len(cand) - 1)) >= 0:
        parts.append(text[at:j])
        need -= j - at
        at = j + len(cand)
    return "".join([*parts, text[at : at + need]])


def _before(text: str, cand: str, at: int, need: int = BEFORE) -> str:
    parts = []
    while (j := text.rfind(cand, max(0, at - need - len(cand) + 1), at)) >= 0:
        parts.append(text[j + len(cand) : at])
        need -= at - j - len(cand)
        at = j
    return "".join([text[max(0, at - need) : at], *reversed(parts)])


class Novelty:
    """Marginal compressed bytes, against a dictionary of identifiers and the surroundings."""

    def __init__(self, dictionary: bytes) -> None:
        self.dictionary = dictionary

    def marginal(self, context: str, candidate: str) -> int:
        """What the candidate adds to its context. The context primes the compressor, so that its own size, and what its
        statistics would make of the candidate's bytes, don't count."""
        primed = zstandard.ZstdCompressionDict(self.dictionary + b" " + context.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressor = zstandard.ZstdCompressor(level=6, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(compressor.compress(candidate.encode())) - len(compressor.compress(b""))

    def scan(self, text: str | None) -> list[tuple[int, int, str, int]]:
        """(start, end, candidate, marginal bytes) of each secret of a text, from left to right."""
        if not text or not may_hold(text):
            return []
        out = []
        for m in CANDIDATE.finditer(text):
            which = m.lastgroup
            s, e = m.span(which)
            cand = m.group(which)
            context = _after(text, cand, e) + " " + _before(text, cand, s)
            n = self.marginal(context, cand if which != "p" else _BREAKS.sub("", cand))
            if n >= (URL_BYTES if which == "u" else MIN_BYTES) and n >= least_bytes(cand):
                out.append((s, e, cand, n))
        return out


def find_secrets(docs: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """(doc_id, start, end, secret, novelty) for each secret of each row; novelty is in bytes, places are in characters.

    Each row is searched by itself, so repeated rows give repeated results and a null doc_id is kept. A null or empty
    text holds none. A text of any length is searched whole, in time that grows with its length. A secret that occurs twice in a text is reported at each place: its other copies don't count as
    context. An empty table gives an empty result; other columns are ignored."""
    known = primed_dictionary(docs) if dictionary is None else dictionary
    tune_arrow(docs.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known)
        for batch in batches:
            hits = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) if t.is_valid for hit in novelty.scan(t.as_py())]
            if hits:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*hits), kinds)], ["doc_id", "start", "end", "secret", "novelty"])

    return texts(docs).mapInArrow(search, "doc_id long, start long, end long, secret string, novelty long")


def redact_text(text: str, hits: list[tuple[int, int, str, int]]) -> str:
    parts, at = [], 0
    for s, e, *_ in hits:
        parts += [text[at:s], MASK]
        at = e
    return "".join([*parts, text[at:]])


def redact_secrets(docs: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """docs with each secret masked in the text, and n_chars, where docs has it, counted again; all rows and columns.

    What isn't a secret is left as it is, null and empty texts too; repeated rows and null keys stay. A column of docs may
    have any name. An empty table gives an empty result."""
    known = primed_dictionary(docs) if dictionary is None else dictionary
    tune_arrow(docs.sparkSession)

    @F.arrow_udf("string")
    def redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        novelty = Novelty(known)
        for batch in batches:
            # null: nothing to change, so most texts don't travel back
            yield pa.array([redact_text(t.as_py(), hits) if t.is_valid and (hits := novelty.scan(t.as_py())) else None for t in batch], pa.string())

    def changed(c: str) -> Column:
        return F.coalesce(F.col(f"`{new}`"), F.col("text")).alias("text") if c == "text" else F.coalesce(F.length(f"`{new}`").cast(docs.schema["n_chars"].dataType), F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`")

    new = "__masked_text"
    while new in docs.columns:
        new += "_"
    return docs.withColumn(new, redact(F.col("text").cast("string"))).select(*[changed(c) for c in docs.columns])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read_table(spark, sf_dir, "documents"))
