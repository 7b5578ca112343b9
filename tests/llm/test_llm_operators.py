"""Each operator on awkward rows (nulls, empty and long texts, ties, repeats, clashing columns, empty tables), and
against brute force, an exact round trip, or held-out rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from tracemill.llm import ann, components, jaccard, lm, mixing, pieces, pii, shared, substrings, toxicity, urlrules, vectors
from tracemill.llm.shared import prepare
from tracemill.llm.tokens import Words, mix, rolled, spans_hash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node string, size string, rank string, shard string, chunk string, score double"


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    texts = [None, "", " \n\t", "one", "Ümläut\u00a0x É", "a b c", "A b\x0bc"]
    base = " ".join(rng.choice(words) for _ in range(90))
    texts += [base, base, base.replace("w1", "w2", 1), base + " tail"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    texts += [f"{' '.join(rng.choice(words) for _ in range(20))} {passage} {rng.random()}" for _ in range(4)]
    texts += ["x " * 300, "x " * 200, " ".join(rng.choice(words) for _ in range(6000)), "ab " * 80 + "y"]
    texts += [f"call bob@mail.example.com or +1 (626) 555-5759 code z9 {i}" for i in range(4)]
    texts += ["ip 10.0.0.300 and 10.0.0.7.8 card 4111 1111 1111 1111, 4111111111111112 a@b.c_d@e.f " + "7" * 3000]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", 0, "a", "b", "c", "d", "e", "f", 0.5) for i, t in enumerate(texts)]
    rows.append((None, "no id at all", None, None, None, *rows[0][5:]))
    rows.append(rows[7])
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_of_pieces():
    texts = [b"", b" a  bb ", b"c", b"\xc3\xa9 x\x0by", b"  "]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words = Words(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert words.counts.tolist() == [len(t.split()) for t in texts]
    assert len(set(words.hash.tolist())) == len({w for t in texts for w in t.split()})


def test_hashes_of_regular_words():
    # Complements of one another whose difference is a product of many powers of two for every base.
    word = b"a"
    while len(word) < 1 << 14:
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
        both = word + b" " + word.translate(bytes.maketrans(b"ab", b"ba"))
        words = Words(np.frombuffer(both, np.uint8), np.array([0, len(both)]))
        assert words.hash[0] != words.hash[1]
        values = np.where(np.frombuffer(both, np.uint8) == 97, words.hash[0], words.hash[1])
        n = len(word)
        (_, first), (_, second) = (rolled(v, np.array([0, n]), n) for v in (values[:n], values[n + 1 :]))
        assert first[0] != second[0] and (spans_hash(values, np.array([0, n + 1]), np.array([n, 2 * n + 1]))[[0]] != spans_hash(values[n + 1 :], np.array([0]), np.array([n]))).all()


def test_windows_have_one_name_each():
    rng = np.random.default_rng(3)
    values = mix(rng.integers(0, 3, 4000).astype(np.uint64))
    for width in (1, 4, 5, 50):
        at, names = rolled(values, np.array([0, 1500, 1500, 4000]), width)
        seen = {}
        for i, name in zip(at.tolist(), names.tolist()):
            assert seen.setdefault(tuple(values[i : i + width].tolist()), name) == name
        assert len(set(seen.values())) == len(seen) and len(at) == 4000 - 2 * (width - 1)


# 1
def test_pii(docs, empty):
    rows = {(r.doc_id, r.tie): r for r in pii.find(docs).collect()}
    assert len({k[0] for k in rows}) == docs.select("doc_id").distinct().count()
    found = [r for r in rows.values() if len(r.base) > 3]
    kinds = collections.Counter(s.kind for r in found for s in r.base)
    assert kinds["email"] == 2 and kinds["ip"] == 1 and kinds["card"] == 1
    # The same words stand near one address in four documents and nowhere else.
    assert any(s.kind in ("term", "gone") for r in rows.values() for s in r.terms)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] is None and clean[1] == "" and clean[3] == "one"
    assert not any("bob@mail" in (t or "") for t in clean.values()) and any("<EMAIL>" in (t or "") for t in clean.values())
    assert pii.sanitise(docs).columns == docs.columns and pii.sanitise(docs).count() == docs.count()
    assert pii.find(empty).count() == 0 and pii.sanitise(empty).count() == 0


def test_pii_terms_everywhere(spark):
    far = " ".join(f"f{i}" for i in range(30))
    rows = [(i, f"zorg ann@mail.example.com {far} Zorg, end") for i in range(4)] + [(4, f"only zorg here {far}")] + [(i, f"plain {i} {far}") for i in range(5, 400)]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(clean) == 400 and not any("zorg" in t.lower() for t in clean.values())
    assert clean[4].startswith("only <TERM> here f0") and clean[0].endswith(" <TERM>, end") and clean[7] == rows[7][1]


def test_pii_agrees_with_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(11)
    values = ["ann@mail.example.com", "10.1.2.3", "+1 (626) 555-5759", "4111 1111 1111 1111"]
    rows = []
    for i in range(600):
        text = [rng.choice(["f", "Gg", "(h)", "i,", "é"]) + str(rng.randint(0, 40)) for _ in range(rng.randint(0, 60))]
        if i % 40 < 4:
            # One word stands near one value and elsewhere in the same text, another in other texts too.
            text += [f"Clue{i % 40},", f"'hint{i % 40}'", values[i % 40], "x" * 5] + [f"t{i}_{j}" for j in range(12)] + [f"clue{i % 40}", f"mailto:hint{i % 40}"]
        if i % 150 == 5:
            text += ["\t", "hint0.", f"clue{i % 4}@mail.example.com"]
        if i % 150 == 7:
            text += ["HINT1!", "(clue2)"]
        rows.append((i, None if i % 97 == 96 else " ".join(text)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op1_pii(spark, str(tmp_path)).toPandas().sort_values("doc_id")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(pii.OP1_SQL).df().sort_values("doc_id")
    assert sum("term:" in s for s in got.spans) > 60 and any("term:" in s and n == 0 for s, n in zip(got.spans, got.n_email + got.n_ip + got.n_card + got.n_phone))
    assert got[want.columns].values.tolist() == want.values.tolist()


def test_pii_shuffles_no_text(spark, monkeypatch):
    far = " ".join(f"é{i}" for i in range(30))
    rows = [(i, f"zorg {'q' * 40} ann@mail.example.com {far} Zorg, end") for i in range(4)] + [(i, f"plain {i} {far}") for i in range(4, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = pii.find(docs)
    whole = {r.doc_id: (r.base, r.terms) for r in found.collect()}
    assert len(whole[0][1]) == 3 and not whole[9][1]
    # No row that holds a text is joined or grouped: what is left to run is one pass from the input.
    assert "Join" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" not in plan
    # More names than a plan holds: all words are counted, and each part of the terms takes a pass.
    monkeypatch.setattr(pii, "NAMES", 1)
    assert {r.doc_id: (r.base, r.terms) for r in pii.find(docs).collect()} == whole


# 2
def test_toxicity(spark, docs, empty):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioubcdfg") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(400):
        text = [rng.choice(words) for _ in range(60)]
        if i % 4 == 0:
            text[::12] = [rng.choice(["wretched", "wretchedly", "loathsome"]) for _ in text[::12]]
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(table, table.filter("doc_id < 280").select("doc_id", "toxic"))
    got = toxicity.score(table.filter("doc_id >= 280"), model, "doc_id", "toxic").collect()
    assert np.mean([(r.score >= 0.7) == (r.toxic == 1) for r in got]) > 0.95
    # A misspelling that was never seen shares most of its character n-grams.
    odd = spark.createDataFrame([(0, " ".join(["wretchedd", "loathsomme"] + words[:20])), (1, " ".join(words[20:42]))], "doc_id long, text string")
    a, b = (r.score for r in toxicity.score(odd, model, "doc_id").orderBy("doc_id").collect())
    assert a > b
    scored = toxicity.score(docs, model, *docs.columns, out="_tm_score")
    assert scored.count() == docs.count() and all(0 <= r._tm_score <= 1 for r in scored.collect())
    assert toxicity.score(empty, model, "doc_id").count() == 0
    none = toxicity.learn(empty, table.limit(0).select("doc_id", "toxic"))
    assert all(r.score < 0.01 for r in toxicity.score(docs, none, "doc_id").collect())


def test_toxicity_sample_skips_long_texts(spark, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    first = labels.orderBy(F.xxhash64("doc_id")).first().doc_id
    table = spark.createDataFrame([(i, f"text {i}" + " long" * 200 * (i == first)) for i in range(20)], "doc_id long, text string")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 500)
    monkeypatch.setattr(toxicity, "train", lambda texts, marks: (sorted(texts), len(marks)))
    assert toxicity.learn(table, labels) == (sorted(f"text {i}" for i in range(20) if i != first), 19)


def test_toxicity_learns_without_python_workers(spark, monkeypatch):
    labels = spark.range(20).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    table = spark.range(20).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    monkeypatch.setattr(RDD, "_to_java_object_rdd", None)  # rows of Python objects go this way, through workers
    monkeypatch.setattr(toxicity, "train", lambda texts, marks: (sorted(texts), len(marks)))
    assert toxicity.learn(table, labels) == (sorted(f"text {i}" for i in range(20)), 20)


def test_workers_keep_tables_of_their_own_operator_only():
    shared.kept("some")["a"] = 1
    list(shared.lean(iter, "some")([]))
    assert shared.kept("some") == {"a": 1}
    list(shared.lean(iter)([]))
    assert shared.kept("some") == {} and pieces._codecs is shared.kept("pieces")


# 3
def test_substrings(docs, empty):
    for window in (50, 8):
        rows = [(r.doc_id, (r.text or "").encode().split()) for r in docs.collect()]
        rank = lambda i: math.inf if i is None else i
        owner = {}
        for i, w in rows:
            for p in range(len(w) - window + 1):
                key = tuple(w[p : p + window])
                owner[key] = min(owner.get(key, math.inf), rank(i))
        want = collections.Counter()
        for i, w in rows:
            gone = set()
            for p in range(len(w) - window + 1):
                if owner[tuple(w[p : p + window])] < rank(i):
                    gone.update(range(p, p + window))
            want[i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()] += 1
        got = collections.Counter(tuple(r) for r in substrings.deduplicate(docs, window=window).collect())
        assert got == want
    assert substrings.deduplicate(empty).count() == 0


# 4
def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[:60] + 0.05 * rng.normal(size=(60, 16))
    x[160:190] = x[5]
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x.astype(np.float32))]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, x[5].tolist(), None), (304, [], 0), (305, [None, 1.0], 0), (306, [1.0, 2.0], 0)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    root = list(range(307))
    links = collections.Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    for i in range(300):
        for j in range(i):
            if i % 2 == j % 2 and y[i] @ y[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert len(got) == 307
    for i in range(307):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], find(i), find(i) == i)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_duplicates(none).count() == 0


def pairs_of_vectors(n, dim, seed):
    """n vectors, the second half at cosine 0.981 from the first."""
    rng = np.random.default_rng(seed)
    x = vectors.unit(rng.normal(size=(n, dim)))
    away = rng.normal(size=(n // 2, dim))
    away = vectors.unit(away - (away * x[: n // 2]).sum(1, keepdims=True) * x[: n // 2])
    x[n // 2 :] = 0.981 * x[: n // 2] + np.sqrt(1 - 0.981**2) * away
    return x.astype(np.float32)


def test_vectors_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 60)
    monkeypatch.setattr(vectors, "WHOLE", 60, raising=False)
    x = pairs_of_vectors(2400, 32, 3)
    y = vectors.unit(x.astype(float))
    want = (y @ y.T >= 0.98).sum(1) - 1
    assert want.sum() >= 2400
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    drawn, assign = [], vectors._assign
    monkeypatch.setattr(vectors, "_assign", lambda centroids, *how: drawn.append(len(centroids["0:32"])) or assign(centroids, *how))
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(table).collect()}
    assert got == dict(enumerate(want.tolist()))
    assert drawn == [40]


def tight_groups(seed, n=3000):
    """A task of n vectors with two pairs of groups of 26, all of a pair at a cosine of some 0.985."""
    rng = np.random.default_rng(seed)
    x = vectors.unit(rng.normal(size=(n, 64)))
    for at in (0, 100):
        away = rng.normal(size=64)
        away -= (away @ x[at]) * x[at]
        x[at + 26] = 0.985 * x[at] + np.sqrt(1 - 0.985**2) * away / np.linalg.norm(away)
        for centre in (at, at + 26):
            x[centre : centre + 26] = x[centre] + 0.0005 * rng.normal(size=(26, 64))
    return pa.table({
        "node": pa.array(np.arange(n)), "vector": pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32())), "times": pa.array(np.ones(n, np.int64)), "shards": pa.array([[0]] * n, pa.list_(pa.int32())),
        "shard": pa.array([0] * n, pa.int32()), "block": pa.array([0] * n, pa.int32()), "i": pa.array([0] * n, pa.int32()), "j": pa.array([0] * n, pa.int32()),
    })


def test_links_between_tight_groups():
    rows = tight_groups(0)
    y = vectors.unit(vectors.matrix(rows["vector"]))
    want = (y @ y.T >= 0.98).sum(1) - 1
    assert want[:52].min() == want[100:152].min() == 51
    found = vectors._found(0.98)(rows.append_column("near", vectors._built(rows)["near"]))
    assert found["links"].to_pylist() == want.tolist()


def test_graph_search_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 24))
    x[400:] = x[:400] + 0.06 * rng.normal(size=(400, 24))
    x = vectors.unit(x)
    found, truth = vectors.search(x, vectors.graph(x), 0.98), vectors.scan(x, np.arange(800), 0.98)
    assert len(truth) > 300 and np.isin(truth, found).mean() > 0.98 and np.isin(found, truth).all()


# 5
def test_mixing(spark, docs, empty):
    rows = mixing.plan(docs).collect()
    assert len(rows) == docs.count()
    total = sum(r["size"] for r in rows)
    shares = {r.source: (r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in shares.values()) - 1.5 * total) < 1e-6 and all(t <= 2 * s + 1e-9 for s, t in shares.values())
    assert all(0 <= r.copies <= 2 for r in rows)
    assert mixing.mix(docs).count() == sum(r.copies for r in rows) and mixing.mix(docs).columns == docs.columns
    assert sorted(map(str, mixing.plan(docs).collect())) == sorted(map(str, rows))
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    big = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 90).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("source"))
    sums = mixing.plan(big).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 200 for r in sums)


# 6
def sets_of(rows, width):
    out = {}
    for r in rows:
        w = lower(r.text).split()
        out[r.doc_id] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    return out


@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 80, 100)])
def test_jaccard(spark, docs, empty, width, num, den):
    rng = random.Random(width)
    words = [f"v{i}" for i in range(40)]
    extra, i = [], 10_000
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 45))]
        for _ in range(4):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(words)
            extra.append((i, " ".join(text[: rng.choice([len(text), len(text) - 1])])))
            i += 1
    table = docs.filter("doc_id is not null").select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    sets = sets_of(table.collect(), width)
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component) for r in jaccard.clusters(table, width=width, num=num, den=den).collect()}
    assert got == {k: (len(sets[k]), find(k)) for k in keys}
    kept = jaccard.keep_one(docs, width=width, num=num, den=den)
    assert kept.columns == docs.columns and kept.filter("doc_id = 7").count() == 1 and kept.filter("doc_id = 8").count() == 0
    assert jaccard.clusters(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_keep_one_by_row(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    near = lambda k: text(k) + " more"
    # Null ids: a near copy of an id's text, texts of their own, a copy among themselves. Id 2 has two texts.
    rows = [(1, text("a")), (None, near("a")), (None, text("b")), (None, text("c")), (None, near("c")), (2, text("d")), (2, text("e")), (3, near("e")), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id or 0), r.text) for r in jaccard.keep_one(table).collect() if r.text)
    c = [t for k, t in kept if t in (text("c"), near("c"))]
    assert len(c) == 1 and kept == sorted([(1, text("a")), (0, text("b")), (0, c[0]), (2, text("d")), (2, text("e"))])
    assert jaccard.keep_one(table).filter("text is null").count() == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7), (200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}


def test_connect(spark, monkeypatch):
    """Of few links in one task, of more by stars: as union-find has it."""
    rng = random.Random(6)
    names = [rng.randrange(-(10**15), 10**15) for _ in range(400)]
    links = [(rng.choice(names), rng.choice(names)) for _ in range(230)] + [(names[i], names[i + 1]) for i in range(90)] + [(5, 5)]
    root = {n: n for link in links for n in link}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for x, y in links:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    table = spark.createDataFrame(links, "x long, y long").repartition(7)
    for most in (len(links), len(links) - 1):
        monkeypatch.setattr(components, "SMALL", most)
        got = components.connect(table).collect()
        assert len(got) == len(root) and {r.node: r.root for r in got} == {n: find(n) for n in root}
    assert components.connect(table.limit(0)).count() == 0


def test_jaccard_rounds_of_few_links(spark):
    """A chain, of which only neighbours link, takes several rounds; over so few links these are few jobs."""
    words = [f"c{i}" for i in range(300)]
    texts = [" ".join(words[i : i + 60]) for i in range(0, 240, 3)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.sparkContext.setJobGroup("rounds of few links", "")
    assert {r.component for r in jaccard.clusters(table).collect()} == {0}
    spark.sparkContext.setJobGroup("other", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds of few links")) < 150


# 7
def test_pieces(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    coded = pieces.encode(docs, "doc_id", "text")
    for r in coded.collect():
        assert list(r.ids) == sp.encode(r.text or "")
    assert all((r.text or "") == r.decoded for r in pieces.decode(coded.withColumnRenamed("text", "given"), "given").select(F.col("given").alias("text"), F.col("text").alias("decoded")).collect())
    assert pieces.digests(docs, "doc_id").filter("not round_trip").count() == 0
    assert pieces.digests(empty, "doc_id").count() == 0


def test_pieces_on_random_text():
    import sentencepiece

    sp, codec, rng = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Codec(pieces.vocabulary()), random.Random(1)
    texts = ["".join(rng.choice("abcdefghinrst    .▁éü1\n語🤖") for _ in range(rng.randint(1, 60))) for _ in range(1500)] + ["x" * 400, " " * 70]
    for text, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(text)


# 8
def test_url_rules(spark):
    urls = ["http://www.Example.com/en/1", "https://a.example.com/en/2?x=/es/", "https://example.com", "http://b.net/es/1#t", "http://net/fr/", "x://anet/es/", None, "no scheme", "://", "http://a.com/#"]
    pages = spark.createDataFrame([(i, u, "mine", 1) for i, u in enumerate(urls + urls[:2])], "page_id long, url string, host string, rank int")
    got = {r.page_id: (r.rule, r.verdict) for r in urlrules.judge(pages, urlrules.rules_table(spark, urlrules.RULES)).collect()}
    assert got == {
        0: ("www.example.com/en/", "allow"), 1: ("example.com/en/", "block"), 2: (None, "allow"), 3: ("net/es/", "block"), 4: ("net/fr/", "block"),
        5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: ("com/", "allow"), 10: ("www.example.com/en/", "allow"), 11: ("example.com/en/", "block"),
    }
    assert urlrules.judge(pages.limit(0), urlrules.rules_table(spark, urlrules.RULES)).count() == 0


# 9
def test_lm(docs, empty, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 9000)
    rows = docs.collect()
    tokens = lambda t: [*lower(t).split(), None]
    train = [r for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    single, pair, after = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for r in train:
        s = tokens(r.text)
        single.update(s)
        for a, b in zip([0, *s[:-1]], s):
            pair[a, b] += 1
            after[a].add(b)
    n, v = sum(single.values()), len(single)
    model = lm.build(docs.filter(~lm.held_out()), 5)
    got = collections.defaultdict(list)
    for r in lm.score(docs, model, 5).collect():
        got[r.doc_id].append(r)
    for r in rows:
        s = tokens(r.text)
        p1 = [(single[w] + 1) / (n + v + 1) for w in s]
        score = 0
        for a, b, p in zip([0, *s[:-1]], s, p1):
            c, k = (len(train) if a == 0 else single[a]), len(after[a])
            score += math.log10(pair[a, b] / (c + k) + k / (c + k) * p if c else p)
        q = got[r.doc_id][0]
        assert (q.n_tokens, q.n_known, q.train_tokens) == (len(s), sum(single[w] > 0 for w in s), n)
        assert math.isclose(q.base_score, sum(map(math.log10, p1)), rel_tol=1e-9)
        assert abs(q.score - score) < 0.0005 * len(s)  # what the quantisation may cost
    assert sum(map(len, got.values())) == len(rows)
    assert lm.score(empty, model, 5).count() == 0
    blank = lm.build(empty, 2)
    assert all(r.n_known == 0 and r.score == 0 for r in lm.score(docs, blank, 2).collect())


def test_elias_fano():
    rng = np.random.default_rng(4)
    for x in (np.zeros(0), [0], [0, 0, 5], rng.integers(0, 1 << 62, 1000), np.arange(300), [1 << 63, (1 << 64) - 1]):
        x = np.sort(np.array(x, np.uint64))
        coded = lm.EliasFano(lm.EliasFano.encode(x))
        assert (coded.decode() == x).all() and (x[coded.find(x)] == x).all()
        other = np.array([v for v in (1, 3, 77, 301, 1 << 62, (1 << 64) - 2) if v not in x], np.uint64)
        assert (coded.find(other) == -1).all()


# 10
def test_centroids_of_clusters():
    rng = np.random.default_rng(8)
    centre = np.concatenate([20 * rng.normal(size=24) + rng.normal(size=(40, 24)) for _ in range(8)])
    lists = ann.Centroids(centre)
    for q in centre[::7] + 0.1:
        nearest = np.argmin(((centre - q) ** 2).sum(1))
        assert lists.walk(q, 0.1)[0][0] == nearest
    assert len(lists.walk(centre[0], ann.RATIOS[-1])[0]) == len(centre)


def test_ann(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[500:600] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("inf")] * 24), (5060, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(table, table.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y, hit = x.astype(float), 0
    assert set(got) == set(range(0, 3000, 20))
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        hit += len(set(want.tolist()) & {i for i, _ in found})
        assert len(found) == 20 and all(math.isclose(score, y[i] @ y[q], rel_tol=1e-9, abs_tol=1e-9) for i, score in found)
    assert hit / (20 * len(got)) >= 0.9
    # Of equal vectors the smaller ids come first, exactly.
    for q, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        equal = [i for i, _ in found if i == 3 or 500 <= i < 600]
        assert equal == [i for i in (3, *range(500, 600)) if i != q][: len(equal)]
    few = table.filter("vec_id < 5")
    assert ann.search(few, few.filter("vec_id % 20 = 0")).count() == 4
    assert ann.search(table.limit(0), table.limit(0)).count() == 0


def test_ann_on_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIMIT", 64)
    monkeypatch.setattr(ann, "QUERIES_A_TASK", 16)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 12))
    x[300:] = x[0]
    rows = [(i, v.tolist(), i, "a", 0.0) for i, v in enumerate(x)]
    rows += [(None, x[1].tolist(), 1, "b", 1.0), rows[40], rows[40], (40, x[7].tolist(), 2, "c", 2.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, vector string, score double")
    got = collections.defaultdict(list)
    for r in ann.search(table, table.filter("vec_id % 20 = 0"), k=120).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    # 100 equal candidates: by id, whatever block they were found in; a query of two vectors has two lists.
    equal = [i for i, _ in got[0] if i >= 300]
    assert equal == list(range(300, 400)) and [i for i, _ in got[300] if i == 0 or i >= 301][:3] == [0, 301, 302]
    assert len(got[40]) == 240 and None not in {i for found in got.values() for i, _ in found}
    assert set(got) == set(range(0, 400, 20))


def test_ann_in_rounds_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 64)
    monkeypatch.setattr(ann, "BEGIN_BYTES", 8 * 12 * 50)
    monkeypatch.setattr(ann, "tune", lambda *_: ann.RATIOS[-1])  # all lists
    assert ann.rounds(50, 31) == [(0, 3), (3, 15), (15, 63)]
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 12)).astype(np.float32)
    x[700:730] = x[40]
    ids = [*range(2000), *[60] * 30, *[61] * 30]  # rows that repeat id and vector are one candidate
    table = spark.createDataFrame([(i, x[i].tolist()) for i in ids], "vec_id long, embedding array<float>").repartition(3)
    got = collections.defaultdict(list)
    for r in ann.search(table, table.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    y = x.astype(float)
    assert set(got) == set(range(0, 2000, 20))
    for q, found in got.items():
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        assert found == np.lexsort((np.arange(2000), -s))[:20].tolist()


def test_ann_tasks_return_no_rows_below_the_floor():
    x = np.arange(1.0, 101)[:, None]
    rows = pa.table({"id": np.arange(100), "vector": pa.array(x.tolist())})
    queries = pa.table({"id": [900, 901], "tie": [0, 0], "vector": [[1.0], [1.0]], "floor": [98.0, -np.inf]})
    got = ann._searched(20)(queries, rows).to_pydict()
    assert list(zip(got["query_id"], got["vec_id"])) == [(900, 99), (900, 98), (900, 97), *((901, i) for i in range(99, 79, -1))]


def test_vectors_of_doubles_and_null_ids(spark):
    x = np.eye(4)[[0, 0, 1, 1, 2, 3]]
    ids = [None, 5, None, None, 7, 7]
    table = spark.createDataFrame([(i, v.tolist(), 1, "n", 2.0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, label int, node string, times double")
    got = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(table).collect())
    assert got == {(None, 1, 5, False): 1, (5, 1, 5, True): 1, (None, 1, None, True): 2, (7, 0, 7, True): 2}


def test_jaccard_links_of_null_and_repeated_ids(spark):
    text = " ".join(f"k{i}" for i in range(60))
    rows = [(None, text, 1, "x"), (5, text.replace("k59", "other"), 2, "y"), (6, "a b c d e f", 3, "z"), (6, text + " tail", 4, "w"), (None, "", 5, "v")]
    table = spark.createDataFrame(rows, "doc_id long, text string, node int, root string")
    got = sorted(((r.doc_id, r.n_shingles, r.component) for r in jaccard.clusters(table).collect()), key=str)
    assert got == sorted([(None, 57, 5), (5, 57, 5), (6, 3, 6), (6, 58, 5), (None, 0, None)], key=str)


def test_jaccard_of_many_near_misses(spark, monkeypatch):
    """A group of near copies, one of near misses, and blocks of few rows: against all pairs."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "BIN", 64)
    monkeypatch.setattr(jaccard, "SHARD", 20_000)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for changes in (1, 1, 2, 2, 3, 3, 4, 5):
        for _ in range(25):
            words = list(base)
            for at in rng.sample(range(100), changes):
                words[at] = f"n{rng.randrange(10**9)}"
            texts.append(" ".join(words))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = sets_of(table.collect(), 4)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id: r.component for r in jaccard.clusters(table).collect()} == {i: find(i) for i in range(len(texts))}
    assert 1 < len({find(i) for i in range(len(texts))}) < len(texts)


def test_scores_against_plain_python():
    """Subwords, their names and the means, one word and one n-gram at a time."""
    mask = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    step = 0xD1342543DE82EF95

    def grams(word):
        chars = [mixed(ord(c) + 1) for c in "\n" + word.decode().lower() + "\n"]
        whole = sum(mixed((v + (i + 1) * step) & mask) for i, v in enumerate(chars)) + len(chars) * 0x8CB92BA72F3D8DD7
        names = [mixed(whole & mask)]
        for k in range(3, 6):
            for i in range(len(chars) - k + 1):
                name = chars[i]
                for v in chars[i + 1 : i + k]:
                    name = mixed((name * step + v) & mask)
                names.append(name)
        return [n >> (64 - toxicity.BITS) for n in names]

    rng = np.random.default_rng(2)
    weights = rng.normal(size=1 << toxicity.BITS)
    texts = ["", "one", "Two two  three", "Ümläut x\x0by É", "word " * 40 + "end", " ".join(f"w{i}" for i in range(30))]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    got = toxicity.scores_of(np.frombuffer(b"".join(raw), np.uint8), offsets, weights, -0.5)
    for text, score in zip(raw, got):
        words = set(text.split())
        logit = -0.5 + sum(np.mean(weights[grams(w)]) for w in words) / max(len(words), toxicity.PAD)
        assert math.isclose(score, 1 / (1 + math.exp(-logit)), rel_tol=1e-9)
