"""Fill-in-middle against a plain reading of its rules; rank and select against counting."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import fill_middle
from quern.llm.fill_middle import Bits, fill_in_middle, restored

TEXTS = [None, "", " ", "a", "word", "Two words.", "né über 中文 ﬁ 𝒳x", "has <P> in it", "<S>", "ends <", "<M", "a<P", "x" * 70_000, "\n\r\n\t\0", "ab1cd22ef " * 900, "<" * 40, "S>x<" * 30, "M>P>" * 9]


def plainly(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, s = len(tokens), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(s[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("run", [1, 50, 4_000_000])
def test_as_the_rules_say(spark, run, monkeypatch):
    """Every text under many ids, repeated rows, null ids and clashing columns; runs of any size give the same."""
    monkeypatch.setattr(fill_middle, "RUN_BYTES", run)
    rows = [(31 * k + j, t) for k, t in enumerate(TEXTS) for j in range(3 if run == 1 else 9)] + [(None, "null id"), (None, "null id"), (-7, "again"), (-7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("Form", "n", "h1", "output", "a.b")}).repartition(2)
    got = fill_in_middle(docs)
    found = got.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found], key=key) == sorted([(i, *plainly(i, t)) for i, t in rows], key=key)
    texts = {i: t or "" for i, t in rows}
    assert all(r.back == texts[r.doc_id] for r in found)
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_rank_and_select():
    rng = np.random.default_rng(5)
    for size in (0, 1, 63, 64, 511, 512, 513, 5000):
        for share in (0.0, 0.02, 0.5, 1.0):
            flags = rng.random(size) < share
            bits, places = Bits(flags), np.arange(size + 1)
            assert (bits.rank(places) == np.concatenate([[0], np.cumsum(flags)])).all()
            ones = np.flatnonzero(flags)
            assert (bits.select(np.arange(len(ones))) == ones).all()
