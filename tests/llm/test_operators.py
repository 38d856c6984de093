"""Every training-data operator against brute force or DuckDB, and on awkward tables."""

import hashlib
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lanewise.llm import html, lattice, packing, pieces, quality, registry, secrets, simhash, stages, suffix, topk, toxicity, urls

SF = "/root/testdata/sf0.001"
LONG = "passage " + " ".join(f"w{i % 97}x{i}" for i in range(60))
#: Null, empty, repeated and near-equal texts, a null id, a long word, and columns whose names clash with those inside.
ROWS = [(1, LONG), (2, LONG), (2, LONG), (3, "start " + LONG), (4, None), (5, ""), (None, "no id"), (6, "x" * 5000), (7, "password = abcdefgh1 " * 3), (8, "é" * 150), (9, LONG.upper())]


@pytest.fixture
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "id": F.lit(1), "own": F.lit(2), "fp": F.lit("z"), "key": F.lit("k")})


@pytest.mark.parametrize("name", [n for n in registry.oracle_sql()])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert rows == sorted(repr(tuple(dict(zip(names, r))[c] for c in columns)) for r in cursor.fetchall())


def test_simhash(spark, docs):
    rows = simhash.near_duplicates(spark, docs, shard=8, chunk=2, visitors=2).collect()
    assert len(rows) == len(ROWS)
    of = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows}
    prints = [(i, simhash.fingerprint((t or "").encode()) % 2**64) for i, t in ROWS]
    label = {f: {f} for _, f in prints}
    for _, a in prints:
        for _, b in prints:
            if (a ^ b).bit_count() <= 2 and label[a] is not label[b]:
                label[a] |= label[b]
                for f in label[b]:
                    label[f] = label[a]
    for i, f in prints:
        assert of[i, f"{f:016x}"] == min((j for j, g in prints if g in label[f] and j is not None), default=None)
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield len(t), sum(gone), sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(bytes(x for x, y in zip(t, gone) if not y)).hexdigest()


@pytest.mark.parametrize(("length", "group"), [(200, 200), (200, 1), (40, 1)])
def test_suffix(spark, docs, length, group):
    rows = suffix.remove_repeats(spark, docs, length=length, group=group).collect()
    want = sorted(brute_repeats([(t or "").encode() for _, t in ROWS], length))
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == want


def test_multikey_sort():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 99, int(rng.integers(0, 40))).astype(np.uint8)) for _ in range(500)]
    order, shared = suffix.multikey_sort(words)
    got = [words[i].ljust(40, b"\0") for i in order]
    assert got == sorted(got)
    for k in range(1, len(got)):
        assert shared[k] == next((8 * d for d in range(5) if got[k][8 * d : 8 * d + 8] != got[k - 1][8 * d : 8 * d + 8]), 40)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in rng.normal(0, 1, 8)] for _ in range(60)] + [[1.0] * 8] * 40 + [None, [], [float("nan")] * 8, [1.0, None] * 4, [1e30] * 8, [2.0] * 3, [3.0] * 3]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, id string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(spark, df, df.filter("vec_id % 10 = 0"), block=8, query_block=4).collect()}
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in (q for q in whole if q % 10 == 0):
        scores = sorted((-max(-topk._LONG, min(topk._LONG, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(scores[:10])}
    assert got == want
    assert topk.top_k(spark, df.limit(0), df).count() == 0


def test_packing(spark, docs):
    rows = packing.packed(spark, docs, capacity=64).collect()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_vocabulary())
    want = Counter()
    for i, t in ROWS:
        ids = own.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want[i, k // 64, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    ends: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 64
    assert packing.packed(spark, docs.limit(0)).count() == 0


def test_other_vocabularies_are_encoded_whole():
    """A byte-level file cuts words in another way: the fast path would give other ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        own, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
        for text in ("It's 12 Words, HERE\n\n  and\there", "naïve Ärger µ 3½", "", " ", "日本 <|endoftext|> x"):
            assert encoder(text) == np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_plan_places_everything():
    rng = np.random.default_rng(3)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 2049, 300), rng.integers(1, 40, 300))}
    placed = Counter()
    for length, a, b, _, _ in packing.plan(counts):
        placed[length] += b - a
    assert placed == counts
    used = max(r[3] + r[2] - r[1] for r in packing.plan(counts))
    assert used <= 1.10 * sum(n * c for n, c in counts.items()) / 2048  # half of these pieces need a sequence of their own


def test_pieces(spark, docs):
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=pieces.default_model())
    ids = pieces.encoded(docs)
    assert Counter(bytes(r["ids"]) for r in ids.collect()) == Counter(np.array(own.encode(t or ""), "<u4").tobytes() for _, t in ROWS)
    assert Counter(r["text"] for r in pieces.decoded(ids).collect()) == Counter(t or "" for _, t in ROWS)


def test_relational_lattice_equals_the_array_form(spark, docs):
    more = spark.createDataFrame([(10, "a  b   c é𝄞x\tq\n"), (11, "   "), (12, "▁▁ a▁b"), (13, "x" * 61 + " " + "x" * 60), (14, "internationalization 你好 😀😀")], "doc_id long, text string")
    df = docs.unionByName(more, allowMissingColumns=True)
    rows = lambda d: Counter((r["doc_id"], bytes(r["ids"])) for r in d.collect())
    assert rows(lattice.encoded_relational(spark, df)) == rows(pieces.encoded(df))
    assert lattice.encoded_relational(spark, df.limit(0)).count() == 0


def message(fields):
    """A protocol buffer message of (number, whole number, bytes or float)."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    one = lambda n, v: varint(n << 3 | 5) + struct.pack("<f", v) if isinstance(v, float) else varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v
    return b"".join(one(n, v) for n, v in fields)


def unigram_model(kind=1, fallback=1):
    """A model made by hand: three special pieces, the bytes, and pieces with scores."""
    normal = [("▁", -3.0), ("a", -2.5), ("b", -2.75), ("ab", -4.0), ("▁a", -3.5), ("▁ab", -5.5), ("ba", -3.25), ("bab", -7.5), ("c", -5.0), ("abc", -6.0), ("▁▁", -4.5), ("cab", -6.25)]
    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], *[(p, s, 1) for p, s in normal]]
    return message([*[(1, message([(1, p.encode()), (2, s), (3, t)])) for p, s, t in pieces_], (2, message([(3, kind), (35, fallback)])), (3, message([(1, b"identity"), (3, 1), (4, 0)]))])


def test_unigram_models_take_the_best_sum(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor

    path = str(tmp_path / "unigram.model")
    open(path, "wb").write(unigram_model())
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("aabbc  é"), int(rng.integers(0, 14)))) for _ in range(150)] + ["babab cabc", "   ", ""]
    own = SentencePieceProcessor(model_file=path)
    want = {i: np.array(own.encode(t), "<u4").tobytes() for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: bytes(r["ids"]) for r in pieces.encoded(df, path).collect()} == want
    assert {r["doc_id"]: bytes(r["ids"]) for r in lattice.encoded_relational(spark, df, path).collect()} == want
    assert pieces.encoded(df.limit(0), path).count() == 0
    for kind, fallback in ((3, 1), (4, 1), (1, 0)):
        with pytest.raises(ValueError):
            pieces.model_kind(unigram_model(kind, fallback))


def test_op7_query(spark):
    """The query's columns against the library, on whole documents."""
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=pieces.default_model())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pieces.op7_sentencepiece(spark, SF).collect():
        ids = np.array(own.encode(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_crc32"], r["round_trip"]) == (len(ids), zlib.crc32(ids.tobytes()), True)


def test_pages_without_an_article(spark):
    """Neutral names and no article: link lists go, and a short block is told by its neighbours."""
    long = "word " * 40
    menu = "".join(f"<p><a href=/{i}>go {i}</a></p>" for i in range(5))
    page = f"<body><div class=c1>{menu}<p>Short note</p>{menu}</div><div class=c2><p>{long}one.</p><p>Short line.</p><p>{long}two.</p></div><div class=c3>{menu}</div></body>"
    deep = "<div>" * 60_000 + "</ul>" * 60_000  # an end tag without a start costs one look
    rows = [(1, page, None), (2, deep, "x"), (2, deep, "x"), (None, page, "y")]
    df = spark.createDataFrame(rows, "page_id long, html string, n_chars string").withColumn("own", F.lit(1))
    got = [(r["page_id"], r["text"]) for r in html.extracted(df).collect()]
    text = f"{long}one. Short line. {long}two."
    assert sorted(got, key=str) == sorted([(1, text), (2, ""), (2, ""), (None, text)], key=str)
    assert html.extracted(df.limit(0)).count() == 0
    used = {html.FEATURES[f] for f, *_ in html.trained_tree() if f >= 0}
    assert {"words", "link_density"} <= used and used & {"words_before", "words_after"} and used & {"link_density_before", "link_density_after"}


def test_html(spark):
    page = "<html><nav><a href=/a>Menu</a></nav><div class='ad'>Buy now.</div><article><h1>Title&amp;</h1><script>var t='</p>';</script><p>One <b>two</b>\n three.<p>Hi.</article><div class=comments><p>" + "me too " * 40 + "</p></div><footer>End</footer>"
    cases = [page, None, "", "<", "<p", "<script>never closed", page[: page.index("three") + 5]]
    df = spark.createDataFrame([(i, h, "t") for i, h in enumerate(cases)], "page_id long, html string, text string")
    rows = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extracted(df).collect()}
    assert rows[0] == ("Title& One two three. Hi.", 25)
    assert [rows[i][0] for i in range(1, 6)] == [""] * 5 and rows[6][0] == "Title& One two three"


def test_quality_and_secrets_on_awkward_rows(spark, docs):
    rows = quality.quality_verdicts(spark, docs).collect()
    assert len(rows) == len(ROWS) and all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)
    found = {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["found"]] for r in secrets.secret_spans(spark, docs).collect()}
    assert found[7] == [("assign", 0, 20), ("assign", 21, 41), ("assign", 42, 62)] and not found[4] and not found[5]
    assert quality.quality_verdicts(spark, docs.limit(0)).count() == secrets.secret_spans(spark, docs.limit(0)).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]{12,}") == [frozenset({"aki", "kia"})]
    assert secrets.trigram_query("[0-9a-f]{32,}") == []
    assert frozenset({"tok", "oke", "ken"}) in secrets.trigram_query(secrets.BASE[0].pattern)


def test_urls_follow_links(spark):
    link = "<link rel='canonical' href='%s'>"
    rows = [
        (1, "http://a.org/x", link % "https://b.example.com/en/1"), (2, "https://b.example.com/en/1?utm_source=f#top", None), (3, "http://c.org/y", "<meta http-equiv=refresh content='0;url=http://a.org/x'>"),
        (4, "http://d.org/", None), (5, None, None), (6, "no scheme", link % "http://b.example.com/en/1"), (7, "http://www.example.com/en/2", link % "http://b.example.com/en/1"), (4, "http://d.org/", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("node", F.lit(1))
    rules = spark.createDataFrame(urls.RULES, "host string, path string, action string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.url_verdicts(spark, df, rules).collect()}
    assert got == {1: (None, "block"), 2: ("example.com/en/", "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("www.example.com/en/", "allow")}
    assert urls.url_verdicts(spark, df.limit(0), rules).count() == 0


LINKS = [
    ("http://good.org/a", "<link rel=canonical href='/go?u=http://b.example.com/en/1'>", "allow"),  # a path, not the URL in it
    ("http://good.org/b", "<!-- <link rel=canonical href='http://b.example.com/en/1'> -->", "allow"),
    ("http://good.org/c", "<script>'<link rel=canonical href=http://b.example.com/en/1>'</script>", "allow"),
    ("http://z.org/a?ref=2", "<link rel=canonical href=http://b.example.com/en/1>", "block"),
    ("https://z.org/a/?ref=1", None, "allow"),  # another resource, and no link
    ("http://two.org/", "<link rel=canonical href=http://two.org/x><link rel='alternate CANONICAL' href='http://b.example.com/en/2'>", "block"),
    ("http://b.org/x/y", "<base href='//b.example.com/en/z/'><meta content=\"0; URL='../1?p=1&amp;q=2#f'\" http-equiv=Refresh>", "block"),  # b.example.com/en/1?p=1&q=2
    ("http://b.org/x/z", "<base href='//b.example.com/en/z/'><link rel=canonical href='../../other'>", "allow"),  # b.example.com/other has no rule but com/
    ("http://f.net/fr/1", None, "block"), ("http://q.org/p?a=1", "<link rel=canonical href='?b=2'>", "block"), ("http://q.org/p?b=2", "<link rel=canonical href='http://f.net/fr/1'>", "block"),
    ("http://q.org/p", None, "allow"), ("HTTP://Q.org/p?b=2#top", None, "block"), ("http://m.org/", "<link rel=canonical href='mailto:a@b.example.com'><link rel=canonical href=''>", "allow"), ("no scheme", "<link rel=canonical href='http://b.example.com/en/1'>", "allow"), (None, None, "allow"), (None, "", "allow"),
    ("http://deep.org/" + "a/" * 300 + "x", "<link rel=canonical href='" + "../" * 400 + "y'>", "allow"), ("http://www.example.com/en/1", "<link rel=canonical href=http://b.example.com/en/1>", "allow"),
]


def test_links_against_duckdb(spark, tmp_path):
    """Every way that a page links, by what a browser makes of it, and by the oracle."""
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(LINKS)], "page_id long, url string, html string")
    df.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in urls.op10_url_filter(spark, str(tmp_path)).collect()}
    assert {i: v[-1] for i, v in got.items()} == {i: v for i, (*_, v) in enumerate(LINKS)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.execute(urls.ORACLES["op10_url_filter"]).fetchall()} == got


def test_shards_are_split(spark, monkeypatch):
    """Shards far over their target get trees of their own; the components are those of brute force."""
    for name, n in (("SPLIT", 12), ("SPLIT_SAMPLE", 16), ("ROUTED", 20), ("SAMPLE", 16)):
        monkeypatch.setattr(simhash, name, n)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60).astype(object)
    points = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (6, 2))} | {int(b) for b in base} | set(range(40)))
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    edges = [(r["src"], r["dst"]) for r in simhash.links(spark, df, 2, shard=4, chunk=4, visitors=8).collect()]

    def labels(pairs):
        of = {p: p for p in points}
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                least = min(of[a], of[b])
                if (of[a], of[b]) != (least, least):
                    of[a] = of[b] = least
                    changed = True
        return of

    assert labels(edges) == labels([(a, b) for k, a in enumerate(points) for b in points[k + 1 :] if (a ^ b).bit_count() <= 2])


def test_pairs_of_terms_are_learned():
    """An insult beside a group is toxic, either alone is not: the factors tell them apart, and equal a sum over pairs."""
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for _ in range(1200):
        insult, group = rng.random(2) < 0.5
        words = [*rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"], 4), *["idiots"] * int(insult), *["outsiders"] * int(group)]
        rows.append(toxicity.terms(" ".join(words).encode()))
        labels.append(float(insult and group))
    machine = toxicity.fit(rows, np.array(labels))
    score = lambda t: machine.score(toxicity.terms(t.encode()))
    assert score("alpha idiots outsiders beta") > 0.7 > 0.3 > max(score("alpha idiots beta"), score("alpha outsiders beta"), score("alpha beta"), score(""))
    flat = toxicity.Machine(machine.index, machine.x, machine.bias, machine.linear, np.zeros_like(machine.factors))
    alone = [flat.score(toxicity.terms(t)) for t in (b"alpha idiots outsiders", b"alpha idiots", b"alpha outsiders")]
    assert alone[0] - max(alone[1:]) < 0.5  # without factors the pair is hardly told from its parts
    own = [i for i in machine.index[toxicity.terms(b"alpha idiots outsiders beta")] if i >= 0]
    z = machine.bias + sum(machine.linear[i] * machine.x[i] for i in own) + sum(machine.factors[a] @ machine.factors[b] * machine.x[a] * machine.x[b] for k, a in enumerate(own) for b in own[k + 1 :])
    assert abs(score("alpha idiots outsiders beta") - 1 / (1 + np.exp(-z))) < 1e-9


def test_very_long_texts(spark):
    """Texts longer than a segment, a slice or a batch of words: windows across the borders of segments count."""
    rng = np.random.default_rng(8)
    parts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 50_000)) for _ in range(2)]
    passage = " ".join(f"p{x}" for x in rng.integers(0, 10**6, 40_000))
    texts = [parts[0] + passage, passage + parts[1], "tick " * 60_000, parts[1][:1000]]
    assert len(passage) > suffix.SEGMENT
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(spark, df).collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts], 200)))
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(spark, df).collect()}
    assert prints[2] == f"{xxhash.xxh64_intdigest(b'tick tick tick', 42):016x}"
    kept = packing.packed(spark, df).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_vocabulary())
    assert {r["doc_id"]: r["n"] for r in kept} == {i: len(own.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_toxicity(spark, docs):
    sf = "/root/testdata/sf0.01"
    rows = toxicity.op8_toxicity_fm(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.03 * len(clean)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] < 0.5 for r in toxicity.toxicity_scores(spark, docs, none).collect()} == {True}


def test_stages_keep_columns(spark, docs):
    for stage in (stages.drop_near_duplicates, stages.drop_repeats, stages.redact_secrets):
        assert stage(spark, docs, SF).columns == stages.COLUMNS
    kept = stages.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in kept if r["text"] and r["text"].startswith("passage")) == [1]
    hidden = {r["doc_id"]: r["text"] for r in stages.redact_secrets(spark, docs, SF).collect()}
    assert hidden[7] == "[assign] [assign] [assign] " and hidden[9] == LONG.upper()


def test_quality_follows_the_group(spark):
    """One text, with one symbol in ten words, in a group of such texts and in a group without symbols: only the second rejects it."""
    words = lambda i, n: " ".join(f"word{i}x{k}" for k in range(n))
    marked = lambda i: " ".join(f"word{i}x{k}" + ("#" if k % 12 == 0 else "") for k in range(60))
    rows = [(i, "en", "code", marked(i)) for i in range(120)] + [(200 + i, "en", "prose", words(i, 60)) for i in range(120)] + [(400, "en", "prose", marked(0)), (401, "en", "rare", marked(0))]
    got = {r["doc_id"]: r for r in quality.quality_verdicts(spark, spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
    assert got[0]["symbols_pm"] == got[400]["symbols_pm"] == 83 and got[0]["kept"] and not got[400]["kept"] and not got[400]["base_failed"]
    # A small group has the sketch of its language, in which marked texts are half.
    assert got[401]["kept"] and got[401]["most_symbols_pm"] == got[0]["most_symbols_pm"] and all(got[200 + i]["kept"] for i in range(120))
    # Every fence against the exact percentile of its group: at or above it by less than 1 part in 32.
    for source in ("code", "prose"):
        own = [got[r[0]] for r in rows if r[2] == source]
        for rule in quality.RULES:
            exact = sorted(r[rule] for r in own)[-(-quality.FENCE * len(own) // 100) - 1]
            assert {exact <= r[f"most_{rule}"] <= exact * 33 / 32 for r in own} == {True}


def test_near_dedup_stage_tells_rows_of_one_id_apart(spark):
    """Three texts under id 2: one is a copy of id 1, the others stand for groups of their own."""
    a, b, c = (" ".join(f"{w}{k}" for k in range(80)) for w in ("alpha", "beta", "gamma"))
    rows = [(1, a), (2, a), (2, b), (5, b), (2, c), (2, c), (None, b), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    kept = stages.drop_near_duplicates(spark, df, SF)
    assert kept.columns == stages.COLUMNS and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, a), (2, b), (2, c), (None, b), (7, None)])
