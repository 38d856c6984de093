"""The corpus pipeline against a chain of brute-force stages, and its stages on awkward rows."""

import re
import shutil
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lanewise.llm import packing, secrets, stages, toxicity

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_score(machine, text):
    """Every pair of terms one by one."""
    own = [i for i in machine.index[toxicity.terms((text or "").encode())] if i >= 0]
    z = machine.bias + sum(machine.linear[i] * machine.x[i] for i in own)
    z += sum(float(machine.factors[a] @ machine.factors[b]) * machine.x[a] * machine.x[b] for k, a in enumerate(own) for b in own[k + 1 :])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def without_repeats(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield bytes(x for x, y in zip(t, gone) if not y).decode("utf-8", "ignore")


def without_secrets(text):
    found = sorted((m.start(), rank, m.end(), rule.kind) for rank, rule in enumerate(secrets.RULES) for m in re.finditer(rule.pattern, text) if len(m[rule.value]) >= rule.least)
    out, at = "", 0
    for start, _, stop, kind in found:
        if start >= at:
            out += text[at:start] + f"[{kind}]"
        at = max(at, stop)
    return out + text[at:]


def test_run_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    machine = toxicity.learn(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(i, t) for i, t in rows if plain_score(machine, t) < toxicity.TOXIC_AT]
    prints = {i: plain_fingerprint(t) for i, t in rows}
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints.items():
            for j, b in prints.items():
                if label[j] > label[i] and (a ^ b).bit_count() <= 2:
                    label[j], changed = label[i], True
    rows = [(i, t) for i, t in rows if label[i] == i]
    rows = [(i, t) for (i, _), t in zip(rows, without_repeats([t for _, t in rows]))]
    own = Tokenizer.from_file(packing.default_vocabulary())
    want = Counter()
    for i, t in rows:
        ids = own.encode(without_secrets(t), add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), packing.CAPACITY):
            part = ids[k : k + packing.CAPACITY]
            want[i, k // packing.CAPACITY, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(rows) < docs.count()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= packing.CAPACITY


def test_run_without_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{SF}/labels.parquet", tmp_path / "labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_on_awkward_rows(spark, stage):
    """Null in every column, an empty and a very long text, a repeated row and a column that the stage doesn't know."""
    long = " ".join(f"w{i * 7919 % 1_000_003}" for i in range(120_000))  # no word twice
    rows = [(1, long), (2, None), (3, ""), (None, "a row without an id"), (4, "one row, twice"), (4, "one row, twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long"), "id": F.lit("x"), "row": F.lit("y")})
    out = stage(spark, df, SF)
    assert out.columns == stages.COLUMNS
    got = Counter((r["doc_id"], r["text"] or "") for r in out.collect())
    texts = {i: t or "" for i, t in rows}
    if stage is stages.drop_near_duplicates:  # null and empty texts are one group, and so are the rows that are equal
        assert got == Counter({(i, texts[i]): 1 for i in (1, 2, None, 4)})
    else:
        assert got == Counter((i, t or "") for i, t in rows)
