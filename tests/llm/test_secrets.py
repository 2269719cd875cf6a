"""The secret scan: kinds of secrets, plain recomputation of the novelty, time on long texts, awkward rows."""

import time

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from spindrift.llm import secrets

DICTIONARY = b"configuration token password river stone value"
LETTERS = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def random_key(rng, n=24):
    return "".join(rng.choice(LETTERS, n))


@pytest.mark.parametrize(
    "text, secret",
    [
        ('password = "p@ss!W0rd#9xQ$7zL"', "p@ss!W0rd#9xQ$7zL"),
        ("password: p@ss!W0rd#9xQ$7zL and more", "p@ss!W0rd#9xQ$7zL"),
        ("see postgres://u:Zx9Qw3Er5Ty7Ui@host/db now", "Zx9Qw3Er5Ty7Ui"),
        ("amqp://guest:S3cr3t!x9Zq@mq:5672", "S3cr3t!x9Zq"),
    ],
)
def test_kinds(text, secret):
    assert [h[2] for h in secrets.Novelty(DICTIONARY).scan(text)] == [secret]


@pytest.mark.parametrize("text", ["token: https://example.com/a1/b2-c3?x=1", "auth = user.name1@example.com", "http://example.com:8080/path@x", 'secret = "river stone"', 'password = getpass(prompt="x1")', 'token = os.environ["MY_TOKEN_1"]'])
def test_what_is_none(text):
    assert secrets.Novelty(DICTIONARY).scan(text) == []


def plain_scan(text):
    """The same without the quick filter, and with the context cut from the whole text with all copies taken out."""
    out = []
    for m in secrets.CANDIDATE.finditer(text):
        s, e, cand = *m.span(m.lastgroup), m.group(m.lastgroup)
        context = text[e:].replace(cand, "")[: secrets.AFTER] + " " + text[:s].replace(cand, "")[-secrets.BEFORE :]
        primed = zstandard.ZstdCompressionDict(DICTIONARY + b" " + context.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressor = zstandard.ZstdCompressor(level=6, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
        n = len(compressor.compress(cand.encode())) - len(compressor.compress(b""))
        if n >= (secrets.URL_BYTES if m.lastgroup == "u" else secrets.MIN_BYTES) and n >= secrets.least_bytes(cand):
            out.append((s, e, cand, n))
    return out


def test_scan_by_plain_version(spark, sf_dir):
    novelty = secrets.Novelty(DICTIONARY)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").collect()]
    rng = np.random.default_rng(3)
    key = random_key(rng)
    texts += [f"token={key} and then a few words, token={key}", f"api_key = '{key}' " * 4, " ".join(f"secret: {random_key(rng)}" for _ in range(30))]
    got = [novelty.scan(t) for t in texts]
    assert any(got) and got == [plain_scan(t) for t in texts]


@pytest.mark.parametrize("made", [lambda rng: "\n".join(f"token = {random_key(rng)}" for _ in range(20_000)), lambda rng: "token=" * 60_000, lambda rng: "password = " + "x1!" * 100_000, lambda rng: "http://a:" * 40_000, lambda rng: "a" * 300_000 + " token"])
def test_time_grows_with_the_text(made):
    text = made(np.random.default_rng(1))
    start = time.process_time()
    secrets.Novelty(DICTIONARY).scan(text)
    assert time.process_time() - start < 30


def test_clashing_column_and_repeated_rows(spark):
    key = random_key(np.random.default_rng(2))
    rows = [(1, f"token = {key}"), (1, f"token = {key}"), (None, f"token = {key}"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__masked_text", F.lit("own"))
    out = secrets.redact_secrets(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sum(secrets.MASK in (r.text or "") for r in got) == 3 and {r["__masked_text"] for r in got} == {"own"} and len(got) == 5
