"""Cases that only show at scale, in small: hot keys, long urls, one-word items, large draws; and queries against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from barloom.llm import bagminhash, decontaminate, embedding_lsh, lang_id, mixing, queries, secret_scan, url_filter
from barloom.llm.common import hashes, join_sized, keyed, pieces, shared_folder, unused

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_large_draws_are_exact():
    """Beyond the generator's range the mean and the spread are those of the hypergeometric distribution; below it both ways agree."""
    rng = np.random.default_rng(1)
    n, rest, take = 3 * 10**9, 5 * 10**9, 10**9
    draws = [mixing.hypergeometric(n, rest, take, rng) for _ in range(300)]
    p = n / (n + rest)
    sd = math.sqrt(take * p * (1 - p) * (n + rest - take) / (n + rest - 1))
    assert abs(np.mean(draws) - take * p) < 5 * sd / math.sqrt(300) and 0.8 < np.std(draws) / sd < 1.2
    small = [mixing.hypergeometric(3, 10**9, 5, rng) for _ in range(50)]
    assert all(0 <= k <= 3 for k in small) and mixing.hypergeometric(10**9, 5, 10**9 + 5, rng) == 10**9
    for totals in (np.array([7, 0, 30]), np.array([10**10, 5])):
        shards, size = 4, -(-int(totals.sum()) // 4)
        parts = [mixing.shard_counts(totals, s, shards, size, 3) for s in range(shards)]
        assert (sum(h for _, h in parts) == totals).all() and all((parts[s + 1][0] == parts[s][0] + parts[s][1]).all() for s in range(3))


def test_a_url_of_many_parameters(spark):
    """Forty parameters make one token, and the verdicts are those of counting every subset."""
    many = "&".join(f"k{i}={i}" for i in range(40))
    urls = [f"http://a{i % 7}.example.com/{'de' if i % 2 else 'en'}/{i}?{many}" for i in range(60)] + [f"https://b{i % 3}.net/x/{i}.html?{many}" for i in range(40)]
    urls += ["HTTP://Sub.Example.COM/de/x?a=1", "http://example.com/DE/", "http://b.org?x", "nothing", None, "", "http://A.NET/?u=://z", "http://x.org/" + "y/" * 3000, "http://q.org/fr/a.b.c?b=1&a=2&a=3", "ftp://localhost//p", "http://u.example.net/en/1"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0])]
    found = url_filter.judge(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, k1 string, items int"))
    names = sorted(found.columns)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    expected = con.execute(f"SELECT {', '.join(names)} FROM ({url_filter.judge_sql()}) q").fetchall()
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in found.collect()))) == sorted(map(repr, expected))
    assert found.where("mined_rule IS NOT NULL").count() > 0


def test_an_item_of_one_frequent_word():
    """It is found where it stands and makes no other item a candidate."""
    rng = np.random.default_rng(2)
    texts = [" ".join(["the", *(f"w{int(x)}" for x in rng.integers(0, 3000, 20))]) for _ in range(2000)]
    index = decontaminate.build(list(enumerate([*texts, "the"])))
    word = int(np.searchsorted(index.words, decontaminate.tokens(pa.array(["the"]))[0][0]))
    assert index.begin[word + 1] - index.begin[word] <= 1 / decontaminate.HEAVY
    assert [h["item_id"] for h in decontaminate.search(index, pa.array(["so the end"]))[0]] == [2000]


def test_decontamination_matches_brute_force(spark):
    """Every document that holds an item word for word is found, and every hit holds the shingles that it needs."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text}
    words = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.lower())
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    own = {d: words(t) for d, t in docs.items()}
    held = {d: shingles(w) for d, w in own.items()}
    found = {(r.doc_id, r.item_id) for r in queries.QUERIES["op8_decontamination"](spark, SF).collect()}
    for i, text in items.items():
        w = words(text)
        needed, line = shingles(w), f" {' '.join(w)} "
        for d in docs:
            if line in f" {' '.join(own[d])} ":
                assert (d, i) in found
            if (d, i) in found and len(w) >= 5:
                question, answer = (shingles(words(p)) for p in decontaminate.question_and_answer(text))
                parts = [s for s in (question, answer) if s and min(map(len, s)) == 5]
                assert len(needed & held[d]) >= 0.8 * len(needed) or parts and all(len(s & held[d]) >= 0.8 * len(s) for s in parts)
    many = decontaminate.contaminated(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"), most_bytes=4000)
    assert {d for d, _ in found} == {r.doc_id for r in many.collect()}  # over several indexes


def test_secrets_match_plain_python(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    kinds = (("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 8), ("access", re.compile(r"AKIA[A-Z0-9]+"), 16), ("hex", re.compile(r"[0-9a-f]+"), 32))
    expected = {}
    for r in rows:
        spans = []
        for k, (name, pattern, least) in enumerate(kinds):
            spans += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in pattern.finditer(r.text or "") if len(m[1] if k == 0 else m[0]) >= least]
        count = Counter(k for _, k, _ in spans)
        expected[r.doc_id] = (count[0], count[1], count[2], hashlib.sha256(",".join(s for *_, s in sorted(spans)).encode()).hexdigest())
    found = queries.QUERIES["op9_secret_scan"](spark, SF).collect()
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found} == expected and len(found) == len(rows)


def test_owners_are_not_repositories(spark):
    """A value in many repositories of one owner is the owner's; one that many owners hold is an example."""
    rows = [(i, "token=ownersvalue99", f"o{0 if i < 4 else i}", f"r{i}") for i in range(4)] + [(10 + i, "token=sharedvalue1", f"o{i}", f"r{i}") for i in range(3)]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, owner string, repo string, k1 int, found string, value string")
    found = {r.doc_id: (r.n_live, r.n_copied) for r in secret_scan.scan_secrets(docs, owner="owner", repository="repo").collect()}
    assert all(found[i] == (1, 0) for i in range(4)) and all(found[10 + i] == (0, 1) for i in range(3))
    clean = secret_scan.redact(docs, owner="owner", repository="repo")
    assert clean.columns == docs.columns and {r.text for r in clean.collect()} == {"[secret]"}


def test_mix_matches_plain_python(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    of = defaultdict(int)
    for r in rows:
        of[r.source] += size[r.doc_id]
    names = sorted(of, key=lambda s: (s is None, s or ""))
    share, free, left = {}, dict(zip(names, [1, 2, 3] * len(names))), float(sum(of.values()))
    while free:
        over = [s for s in free if left * free[s] / sum(free.values()) > 3 * of[s]]
        if not over:
            share |= {s: left * w / sum(free.values()) for s, w in free.items()}
            break
        for s in over:
            share[s] = 3.0 * of[s]
        left -= sum(share[s] for s in over)
        free = {s: w for s, w in free.items() if s not in over}
    found = queries.QUERIES["op1_mixing"](spark, SF).collect()
    source = {r.doc_id: r.source for r in rows}
    taken = defaultdict(int)
    assert len(found) == len(rows)
    for r in found:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == of[s] and math.isclose(r.target, share[s]) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - share[s]) <= 1 for s in names)


def test_embedding_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.01"
    x = np.array([r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()], float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    true = near.sum(axis=1) - 1
    found = np.array([r.n_links for r in queries.QUERIES["op7_embedding_lsh"](spark, folder).orderBy("vec_id").collect()])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()


def test_near_copies_that_fill_buckets(spark):
    """A family of near copies, a template that all differ in, and exact copies: classes are those of all pairs."""
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{int(i)}" for i in rng.integers(0, 10**6, n)]
    base, template = word(60), word(40)
    texts = [" ".join(base[:59] + word(1)) for _ in range(40)] + [" ".join(template + word(25)) for _ in range(40)] + ["same text " * 20] * 30
    docs = spark.createDataFrame([(i, t, "e", "s", 1) for i, t in enumerate(texts)], DOC)
    bags = [Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    label = list(range(len(texts)))
    for _ in range(6):
        for i in range(len(texts)):
            for j in range(i):
                if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total():
                    label[i] = label[j] = min(label[i], label[j])
    found = {r.doc_id: (r.class_id, r.class_size) for r in bagminhash.near_duplicates(docs).collect()}
    sizes = Counter(label)
    assert found == {i: (c, sizes[c]) for i, c in enumerate(label)}


def test_hot_keys_are_joined_once(spark):
    left = spark.range(5000).selectExpr("CASE WHEN id < 3000 THEN 0 ELSE id END AS k", "id AS v")
    right = left.groupBy("k").count().withColumnRenamed("count", "rows")
    out = join_sized(left, right, ["k"], "rows", 5000)
    assert out.count() == 5000 and out.where("k = 0 AND rows = 3000").count() == 3000
    assert pieces(0, 4, 10, 100) == 16 and pieces(10**6, 4, 1000, 10**5) == 1000
    assert unused("k", left) == "_k" and keyed(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().text == ""
    assert spark.range(1).select(*hashes("id")).distinct().count() == 1 and shared_folder(spark)


def test_language_sample_counts_repeated_rows_once(spark):
    rows = [(1, "der hund und die katze", "de")] * 500 + [(i, f"the dog and the cat {i}", "en") for i in range(2, 40)] + [(99, None, None), (98, "", "en")]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, lang string, k1 int, label int")
    model = lang_id.fit(docs, rows=20, per_language=10)
    assert model.languages == ["de", "en"]
    seen = docs.select(lang_id.predict(model, docs.text).alias("p"), "lang").where("lang IS NOT NULL AND text <> ''").collect()
    assert all(r.p["lang"] == r.lang for r in seen)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, name, stage):
    """Empty tables, nulls in every column and extra columns with clashing names."""
    empty = spark.createDataFrame([], DOC)
    assert stage(spark, empty, SF).count() == 0
    rows = [(None, None, None, None, None, 1, "t", 2), (1, "", "en", "a", 0, 1, "t", 2), (2, "good plain words of a text " * 12, "en", "a", 9, 1, "t", 2), (2, "good plain words of a text " * 12, "en", "a", 9, 1, "t", 2), (3, "word " * 30_000, None, None, 9, None, None, None)]
    odd = spark.createDataFrame(rows, DOC + ", size int, target string, k1 int")
    out = stage(spark, odd, SF)
    got = out.collect()
    assert {r.doc_id for r in got} <= {None, 1, 2, 3}
    if name != "mixing":
        assert out.columns == odd.columns
