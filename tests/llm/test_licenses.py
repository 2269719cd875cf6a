"""The licence scan: wrapped texts, a plain version without triggers, and awkward rows."""

import textwrap

from pyspark.sql import functions as F

from spindrift.llm import licenses


def test_wrapped_texts():
    model = licenses.license_model()
    for family, at in (("mit", 13), ("mit", 15), ("bsd", 15), ("gpl", 12), ("apache-2.0", 14), ("isc", 6), ("mpl-2.0", 8)):
        notice = licenses.TEMPLATES[family][at]
        for width in (30, 45, 72):
            text = "Some words of a file.\n\n" + "\n".join(textwrap.wrap(notice, width)) + "\n\nint main() {}"
            got = {f for _, f, *_ in model.scan(text)}
            assert got == {family}, (family, at, width)


def plain_scan(model, text):
    """Every line and every block is classified, whatever words it has."""
    out = []
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and lines[j].strip():
            j += 1
        own = [(k, *x) for k in range(i, j) if (x := model.classify(lines[k]))[0] != licenses.UNKNOWN]
        if not own and j > i + 1 and (x := model.classify(" ".join(lines[i:j])))[0] != licenses.UNKNOWN:
            own = [(i, *x)]
        out += own
        i = j + 1
    return out


def test_scan_by_plain_version(spark, sf_dir):
    model = licenses.license_model()
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").collect()]
    texts += ["\n".join(t) for t in licenses.TEMPLATES.values()] + ["\n\n".join(licenses.OTHERS)]
    got = [model.scan(t) for t in texts]
    assert sum(map(len, got)) > 50 and got == [plain_scan(model, t) for t in texts]


def test_awkward_rows(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [(1, notice), (1, notice), (None, notice), (2, None), (3, ""), (4, "river stone " * 200_000 + "\n" + notice), (5, " \n\t\n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"family": F.lit(1), "paragraph": F.lit(2)})
    got = [(r.doc_id, r.paragraph, r.family) for r in licenses.find_licenses(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, "apache-2.0"), (1, 0, "apache-2.0"), (None, 0, "apache-2.0"), (4, 1, "apache-2.0")], key=str)
    assert licenses.find_licenses(df.limit(0)).collect() == []
