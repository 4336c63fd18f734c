"""Each operator against brute force, an exact round trip or held-out accuracy, and on edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from edge import documents, empty
from oracle import compare, connect
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat, katz, licenses, mixing, neardup, pii, quality, queries, toxicity, vectors

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# op1
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    compare(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name])


def test_topk_many_shards(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 150)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 10)
    monkeypatch.setattr(vectors, "NEXT", 2)
    compare(queries.QUERIES["op1_exact_topk"](spark, SF), connect(SF), queries.SQL["op1_exact_topk"])


def test_topk_hot_vector(spark, monkeypatch):
    """One vector in a third of all rows: its leaf is dealt on by a hash, and all answers stay exact."""
    monkeypatch.setattr(vectors, "SHARD_ROWS", 40)
    r = random.Random(9)
    rows = [(i, [1.0, -2.0, 0.5] if i % 3 == 0 else [r.uniform(-3, 3) for _ in range(3)]) for i in range(600)]
    got = vectors.search(vectors.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), k=5, every=50).collect()
    q = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in rows}
    want = [(i, rank, j, -s) for i in range(0, 600, 50) for rank, (s, j) in enumerate(sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:5], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_overflow(spark):
    df = spark.createDataFrame([(20, [1e30]), (1, [2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="64 bits"):
        vectors.search(vectors.quantised(df)).collect()


def test_topk_edges(spark):
    rows = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (40, [1.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (60, []), (6, [-3.0, 0.5]), (None, [1.0, 1.0]), (7, [1e6, 1e6])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, vectors.search(vectors.quantised(df)).collect()))
    big = 64 * 10**6 * (64 + 128)
    assert got == sorted([(20, 1, 7, big), (20, 2, 20, 64 * 64 * 5), (20, 3, 6, -192 * 64 + 32 * 128)] * 2 + [(60, 1, 5, 0)])
    assert vectors.search(vectors.quantised(df.limit(0))).count() == 0


# op2
def test_bpe(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.rank_table(bpe.read_ranks(path)), special_tokens={})
    df = documents(spark, [(11, " a  b\n\n c d   x 's it's ½² \x1c\x1d z\n  \t ", "e", "a"), (12, "ñ \u0085　 end <|endoftext|> ", "e", "a")])
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(df, path, P.PATTERN, digests=True).collect())
    want = []
    for r in df.collect():
        ids = encoding.encode_ordinary(r.text or "")
        want.append((r.doc_id or -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    back = bpe.decode(bpe.encode(df, path, P.PATTERN), path).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in back) == sorted((r.doc_id or -1, r.text or "") for r in df.collect())
    assert bpe.encode(empty(spark), path, P.PATTERN).count() == 0


def copies(spark, df):
    """A table twice, each copy a partition of its own."""
    made = spark.createDataFrame(spark.sparkContext.parallelize(df.collect() * 2, 2), df.schema)
    assert [len(x) for x in made.rdd.glom().collect()] == [df.count()] * 2
    return made


def test_bpe_repeated_blocks(spark):
    """Blocks of the same rows in the same order: in two partitions, and one after another in one."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    df = documents(spark)
    want = sorted(((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(df.coalesce(1), path, P.PATTERN, digests=True).collect()))
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(copies(spark, df), path, P.PATTERN, digests=True).collect())
    assert got == sorted(want * 2)


def test_bpe_repeated_long_texts(spark, monkeypatch):
    import public_tokenizers as P

    monkeypatch.setattr(bpe, "BLOCK_CODES", 50)  # a long text fills a block alone
    pattern = bpe.make_blocks(P.PATTERN, 2)
    import pandas as pd

    batch = pd.DataFrame({"doc_id": [7, 7], "text": ["one two three four five " * 20] * 2})
    blocks = pd.concat(pattern(iter([batch])))
    assert blocks.loc[blocks["kind"] == 0, "block"].nunique() == 2


# op3
def test_chat_round_trip(spark):
    r = random.Random(1)
    bits = ["###", "</turn>", "\\", "\n", ": ", "h", "l", "c", "#", "<", "/turn>", " ", "#chat 1\n", "é"]
    rows = [(c, t if t < 3 else None, r.choice([None, "user", "assistant", "a: b", "###", "\\c:"]), r.choice([None, "".join(r.choices(bits, k=r.randint(0, 12)))]), 1) for c in range(60) for t in range(4)]
    df = spark.createDataFrame([*rows, (None, None, None, None, 1), *rows[:2]], "conv_id long, turn long, role string, text string, turns int")
    made = chat.format_conversations(df)
    got = {x.conv_id: [tuple(t) for t in x.turns] for x in chat.read_back(made).collect()}
    want = collections.defaultdict(list)
    for x in sorted(df.collect(), key=lambda x: ((-1, x.turn)[x.turn is not None] if x.turn is not None else -1, x.role or "", x.text or "")):
        want[x.conv_id].append((x.role or "", x.text or ""))
    assert got == dict(want)
    loss = {x.conv_id: x.loss_text for x in chat.read_back(made).collect()}
    assert all(loss[c] == "".join(t for role, t in turns if role == "assistant") for c, turns in want.items())
    assert chat.format_conversations(df.limit(0)).count() == 0


# op4
def check_mix(rows):
    sizes, order = collections.Counter(), sorted({r["source"] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    for r in rows:
        sizes[r["source"]] += r["size"]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, list(order), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > 2 * sizes[s] + 1e-9]
        if not full:
            target.update({s: weight[s] * level for s in free})
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)


def test_mix(spark):
    first, again = (queries.op4_mix_sources(spark, SF).collect() for _ in range(2))
    assert sorted(map(tuple, first)) == sorted(map(tuple, again)) and len(first) == read(spark, "documents").count()
    texts = {r.doc_id: len(WORD.findall(r.text or "")) for r in read(spark, "documents").collect()}
    assert all(r["size"] == texts[r["doc_id"]] for r in first)
    source = {r.doc_id: r.source for r in read(spark, "documents").collect()}
    check_mix([{**r.asDict(), "source": source[r["doc_id"]]} for r in first])


def test_mix_edges(spark):
    df = documents(spark)
    drawn = mixing.draw(df, shards=5).withColumn("taken", mixing.taken(F.col("pieces"))).collect()
    assert len(drawn) == df.count()
    check_mix(drawn)
    out = mixing.mix(df, shards=5)
    assert out.columns == df.columns
    assert sum(len(WORD.findall(r.text or "")) for r in out.collect()) == sum(r["taken"] for r in drawn)
    assert mixing.draw(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_splitting_tree(spark):
    quotas = {1: 40, 2: 7, 3: 0, 4: 53}
    got = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "number int, quota long"), 8).collect()
    assert {r.number: r.ends[-1] for r in got} == quotas
    for r in got:  # blocks of a run are dealt by a seeded hash: few neighbours share a shard, and each shard has its quota
        q = spark.createDataFrame([tuple(r) + (quotas[r.number],)], "number int, ends array<long>, quota long")
        dealt = [[x.shard for x in q.select(mixing.block_shards(F.col("number"), F.col("quota"), F.col("ends"), seed).alias("s")).first().s] for seed in (7, 8)]
        blocks = sorted(q.select(F.explode(mixing.block_shards(F.col("number"), F.col("quota"), F.col("ends"), 7))).collect())
        assert [b[0].block for b in blocks] == list(range(quotas[r.number]))
        assert [dealt[0].count(s) for s in range(8)] == np.diff([0, *r.ends]).tolist() == [dealt[1].count(s) for s in range(8)]
        order = [b[0].shard for b in blocks]
        assert quotas[r.number] < 40 or sum(a == b for a, b in zip(order, order[1:])) < quotas[r.number] / 3
    shards = np.diff(np.array([[0, *r.ends] for r in got]), axis=1).sum(axis=0)
    assert shards.max() - shards.min() <= 1 and all(sorted(r.ends) == r.ends for r in got)


# op5
def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").where("pmod(crc32(cast(doc_id as string)), 5) = 0").collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in got]) > 0.93
    hit = toxicity.score_text(model, "The thing was IDIOT idiot, and so on", {})
    assert hit[0] > 0.5 and [s[:2] for s in hit[1]] == [(14, 25)]
    edge = toxicity.score(documents(spark), model).collect()
    assert len(edge) == documents(spark).count() and all(0 <= r.score <= 1 for r in edge)
    assert toxicity.score(empty(spark), model).count() == 0
    none = toxicity.train(documents(spark), labels.limit(0))
    assert {r.score for r in toxicity.score(documents(spark), none).collect()} == {0.0}


def test_field_marginals():
    """Forward-backward with closed-form gaps against the sum over all labellings."""
    import itertools

    r = np.random.default_rng(2)
    m = toxicity.Model(emission=r.normal(size=(3, 2)), start=r.normal(size=2), transition=r.normal(size=(2, 2)))
    words = [0, 0, 1, 0, 2, 1, 0]
    p = np.zeros((7, 2))
    for z in itertools.product((0, 1), repeat=7):
        w = math.exp(m.start[z[0]] + sum(m.emission[c, s] for c, s in zip(words, z)) + sum(m.transition[a, b] for a, b in zip(z, z[1:])))
        p[np.arange(7), z] += w
    want = (p / p.sum(axis=1, keepdims=True))[[2, 4, 5], 1]
    assert toxicity.pass_over(m, np.array([1, 2, 1]), np.array([2, 1, 0]), 1) == pytest.approx(want)
    far = toxicity.pass_over(m, np.array([1, 2]), np.array([10_000, 100_000]), 50_000)
    assert np.isfinite(far).all()


def test_field_fits_whole_texts(monkeypatch):
    """Gaps in closed form and in batches against a sum over every token, and evidence late in long texts."""
    r = np.random.default_rng(3)
    docs = [r.choice(3, n, p=[0.8, 0.1, 0.1]) for n in (1, 2, 5, 40, 40, 700)] + [np.zeros(n, int) for n in (1, 30)]
    toxic = [bool(i % 2) for i in range(len(docs))]
    steps = 5

    def field():
        return toxicity.Model(emission=np.zeros((3, 2)), start=np.zeros(2), transition=np.zeros((2, 2)))

    want = field()
    states = [(d > 0) * int(y) for d, y in zip(docs, toxic)]
    seen_e, seen_t, seen_s = np.zeros((3, 2)), np.zeros((2, 2)), np.zeros(2)
    for d, z in zip(docs, states):
        np.add.at(seen_e, (d, z), 1), np.add.at(seen_t, (z[:-1], z[1:]), 1)
        seen_s[z[0]] += 1
    for turn in range(steps):
        e, t = np.exp(want.emission), np.exp(want.transition)
        want_e, want_t, want_s = np.zeros((3, 2)), np.zeros((2, 2)), np.zeros(2)
        for d in docs:
            f, b = np.zeros((len(d), 2)), np.ones((len(d), 2))
            f[0] = np.exp(want.start) * e[d[0]]
            for i in range(1, len(d)):
                f[i] = (f[i - 1] / f[i - 1].sum()) @ t * e[d[i]]
            for i in range(len(d) - 2, -1, -1):
                b[i] = t @ (e[d[i + 1]] * b[i + 1])
                b[i] /= b[i].sum()
            p = f * b / (f * b).sum(axis=1, keepdims=True)
            np.add.at(want_e, d, p)
            want_s += p[0]
            for i in range(1, len(d)):
                q = f[i - 1][:, None] * t * (e[d[i]] * b[i])[None]
                want_t += q / q.sum()
        rate = 0.5 / (1 + turn / 20)
        want.emission += rate * ((seen_e - want_e) / (seen_e.sum(axis=1, keepdims=True) + 10) * 2 - 0.02 * want.emission)
        want.transition += rate * ((seen_t - want_t) / (seen_t.sum(axis=1, keepdims=True) + 10) * 2 - 0.02 * want.transition)
        want.start += rate * ((seen_s - want_s) / len(docs) - 0.02 * want.start)
    for items in (200_000, 30):
        monkeypatch.setattr(toxicity, "FIT_ITEMS", items)
        got = field()
        toxicity.fit_field(got, [toxicity.compress(d[d > 0], np.flatnonzero(d), len(d)) for d in docs], toxic, steps)
        for x, y in ((got.emission, want.emission), (got.transition, want.transition), (got.start, want.start)):
            assert x == pytest.approx(y)


def test_toxicity_late_in_text():
    """Toxic passages that start after 1,000 tokens weigh in the fit."""
    r = random.Random(6)
    plain = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    texts = [" ".join(plain(1000) + (["vile"] * 3 if k // 2 % 2 else []) + plain(r.randrange(20))) for k in range(80)]
    model = toxicity.fit(texts, np.array([k // 2 % 2 == 1 for k in range(80)]), 0.5)
    assert model.evidence["vile"] and np.abs(model.emission[model.evidence["vile"]]).max() > 0.5
    assert [s[:2] for s in toxicity.score_text(model, "some vile vile vile words", {})[1]] == [(5, 19)]


# op6
def py_counts(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times, hit = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality(spark):
    for df in (read(spark, "documents"), documents(spark, [(13, "a b\n\na b\n c\n c\n", "en", "a"), (14, "a b c d e f a b c d e g # <", "en", "a")])):
        got = quality.verdicts(df, read(spark, "labels")).collect()
        key = lambda x: repr((x[0], *x[1:]))
        want = sorted(((r.doc_id, *py_counts(r.text)) for r in df.collect()), key=key)
        assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == want
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.verdicts(empty(spark), read(spark, "labels")).count() == 0
    assert quality.filter_documents(documents(spark), read(spark, "labels").limit(0)).columns == documents(spark).columns


def test_binomial_tail(spark):
    cases = [(0, 10, 0.01), (3, 50, 0.1), (7, 900, 0.01), (20, 20, 0.5), (40, 78_000, 0.001)]
    for k, n, p in cases:
        logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
        want = 1.0 if k >= n or k > n * p else sum(map(math.exp, logs))
        df = spark.createDataFrame([(k, n)], "k long, n long")
        assert df.select(quality.binomial_tail(F.col("k"), F.col("n"), p)).first()[0] == pytest.approx(want)


def quality_rows(spark, per_stratum, seed=4):
    """Labelled rows whose symbols tell bad from good, in strata of the given sizes."""
    r = random.Random(seed)
    rows, k = [], 0
    for stratum, n in per_stratum.items():
        for _ in range(n):
            good = r.random() < 0.8
            rows.append((k, stratum, [min(20, int(20 * (r.random() * 0.3 if good else 0.2 + r.random() * 0.8))), 0, 0, 0, 0], False, good))
            k += 1
    scored = spark.createDataFrame([x[:4] for x in rows], "doc_id long, stratum string, levels array<int>, base_failed boolean")
    return rows, scored, spark.createDataFrame([(x[0], int(x[4])) for x in rows], "doc_id long, quality int")


def test_cutoffs_are_safe(spark):
    rows, scored, labels = quality_rows(spark, {"en": 4000, "de": 600, "fr": 600, "xx": 60})
    known = quality.labelled(scored, labels)
    graded = quality.grades(known)
    cut = {r.stratum: r.cutoff for r in quality.cutoffs(known, graded).collect()}
    assert set(cut) == {"en", "de", "fr"}  # the smallest stratum can't be certified
    risk = lambda x: max(graded[r][v] for r, v in enumerate(x))
    for s, c in cut.items():
        good, bad = ([x for x in rows if x[1] == s and x[4] == y] for y in (True, False))
        assert sum(risk(x[2]) >= c for x in good) / len(good) <= quality.ALPHA < 0.4 < sum(risk(x[2]) >= c for x in bad) / len(bad)
    # The least cutoff whose exact tail over held-out good rows is small enough, strata counted
    held = {r.doc_id for r in scored.where("substring(md5(cast(doc_id as string)), 1, 1) < 'a'").collect()}
    for s in cut:
        own = [risk(x[2]) for x in rows if x[1] == s and x[4] and x[0] in held]
        tail = lambda c, own=own: sum(math.exp(math.log(math.comb(len(own), j)) + j * math.log(0.02) + (len(own) - j) * math.log(0.98)) for j in range(sum(v >= c for v in own) + 1))
        assert cut[s] == min(c for c in range(quality.LEAST_RISK, 21) if tail(c) <= quality.DELTA / 4)


def test_repeated_labels_certify_nothing_more(spark):
    _, scored, labels = quality_rows(spark, {"en": 300, "de": 100})
    want = quality.cutoffs(known := quality.labelled(scored, labels), quality.grades(known)).collect()
    for i in range(3):
        scored, labels = scored.union(scored), labels.union(labels)
    assert quality.cutoffs(known := quality.labelled(scored, labels), quality.grades(known)).collect() == want


def test_clashing_columns(spark):
    df = documents(spark).withColumn("cutoff", F.lit(1)).withColumn("risk", F.lit(2)).withColumn("stratum", F.lit("s")).withColumn("good", F.lit(True))
    out = quality.filter_documents(df, read(spark, "labels"))
    assert out.columns == df.columns and out.count() > 0


# op7
def py_base(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_pii(spark):
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice("1234 -.+()@ab.é") for _ in range(r.randint(1, 50)))
        assert py_base(t) == pii.base_spans(t), t
    model = pii.train()
    assert pii.spell(pii.added_spans("please call (555) 123-4567 today", [], model)) == "phone:12:26"
    assert pii.added_spans("on date 2024-10-11 and version 10.20.30", [], model) == []
    assert pii.redact_text("mail a.b@c.org or +1 (555) 123-4567.", model) == "mail [EMAIL] or [PHONE]."
    got = pii.find(documents(spark), model).collect()
    assert len(got) == documents(spark).count() and not any(x.spans for x in got)
    assert pii.redact(documents(spark), model).columns == documents(spark).columns and pii.redact(empty(spark), model).count() == 0
    docs = {x.doc_id: x.text for x in read(spark, "documents").collect()}
    assert all(x.base == pii.spell(py_base(docs[x.doc_id])) for x in pii.find(read(spark, "documents"), model).collect())


# op8
def py_groups(rows, width=3, percent=85):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for j, both in collections.Counter(j for g in s for j in where[g]).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for g in s:
            where[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def variants(seed, n):
    r = random.Random(seed)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(8)):
            w[r.randrange(len(w))] = f"v{r.randrange(10_000)}"
        out.append((1000 + i, " ".join(w), "en", "a"))
    return out


@pytest.mark.parametrize("chunk", [2048, 16])
def test_near_duplicates(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    df = documents(spark, variants(1, 150)).unionByName(read(spark, "documents"), allowMissingColumns=True)
    rows = [(r.doc_id if r.doc_id is None or r.n_words else r.doc_id + 5000, r.text) for r in df.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda x: tuple(-1 if v is None else v for v in x)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.group(df).collect()), key=key)
    assert got == sorted(py_groups(rows), key=key)


def test_links_of_chains():
    """Families whose components join step by step within one group, in any order of rows."""
    import pandas as pd

    def split(n, pairs):
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a)] = find(b)
        return {frozenset(i for i in range(n) if find(i) == find(k)) for k in range(n)}

    def check(sets, comp, percent):
        n = len(sets)
        joined = [(i, j) for i in range(n) for j in range(i) if comp[i] == comp[j]]
        near = [(i, j) for i in range(n) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        rows = pd.DataFrame({"group": 1, "node": list(range(n)), "comp": comp, "shingles": [np.array(sorted(s)) for s in sets]})
        got = neardup.linked(percent)(rows)
        assert split(n, joined + list(zip(got["a"], got["b"]))) == split(n, joined + near)

    # Six classes, links x1-x2, x2-x4, x3-x4, x3-x5: the largest component changes while they are joined
    links = [(1, 2), (2, 4), (3, 4), (3, 5)]
    sets = [set(range(1000 * i, 1000 * i + 4)) for i in range(6)]
    for k, (a, b) in enumerate(links):
        shared = set(range(10_000 + 100 * k, 10_000 + 100 * k + 20))
        sets[a] |= shared
        sets[b] |= shared
    check(sets, list(range(6)), 28)
    r = random.Random(5)
    for _ in range(200):
        sets, comp = [], []
        for family in range(3):
            at = 0
            for _ in range(r.randrange(1, 9)):
                at += r.choice((1, 3, 6, 8, 20))
                sets.append(set(range(10_000 * family + at, 10_000 * family + at + 100)))
                comp.append(len(comp) if r.random() < 0.7 or at == 0 or len(sets) < 2 or min(sets[-1]) - min(sets[-2]) > 6 or min(sets[-1]) < min(sets[-2]) else comp[-1])
        order = r.sample(range(len(sets)), len(sets))
        check([sets[i] for i in order], [comp[i] for i in order], 85)


def test_near_duplicates_edges(spark):
    assert neardup.group(empty(spark)).count() == 0
    kept = neardup.keep_one(documents(spark), 3, 85)
    assert kept.columns == documents(spark).columns and {1, 4, 5, 6, 7, 8, 9, 10} <= {r.doc_id for r in kept.collect()}
    assert 3 not in {r.doc_id for r in kept.collect()}


def test_keep_one_row(spark):
    """Null and repeated ids: one row of each group."""
    words = lambda a: " ".join(f"{a}{i}" for i in range(60))
    a, b, c, d = map(words, "abcd")
    rows = [
        (1, a, "x"), (1, a, "y"), (None, a, "x"), (None, a + " more", "x"),  # a group with ids
        (None, b, "x"), (None, b, "x"), (None, b + " more", "x"),  # null ids only
        (2, c, "x"), (2, c + " more", "x"), (3, c, "x"), (3, d, "x"), (1, d + " more", "x"),  # one id in two groups
        (None, None, "x"), (None, " ", "x"), (4, "", "x"), (4, "", "x"),
    ]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, own string"))
    assert kept.columns == ["doc_id", "text", "own"]
    got = [tuple(r) for r in kept.collect()]
    assert len(got) == 8 and set(got) <= set(rows)
    of = lambda x: [r for r in got if (r[1] or "").startswith(x + "0")]
    assert of("a") == [(1, a, "x")] and len(of("b")) == 1 and [r[0] for r in of("c")] == [2] and of("d") == [(1, d + " more", "x")]
    assert sum(not (r[1] or "").strip() for r in got) == 4


# op9
@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz(spark, monkeypatch, order):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 5000)
    df = read(spark, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(9001, None), (None, "the the x"), (9003, ""), (9003, "zzz yyy")], "doc_id long, text string"))
    docs = [(r.doc_id, (katz.START, *(r.text or "").encode().lower().split(), katz.END)) for r in df.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count, hist = collections.defaultdict(collections.Counter), collections.Counter()
    for i, w in docs:
        if not held(i):
            for n in range(1, order + 1):
                count[n].update(w[k - n + 1 : k + 1] for k in range(max(n - 1, 1), len(w)))
                hist.update(w[k - n : k] for k in range(n, len(w)))
    total = sum(count[1].values())

    def good_turing(counts):
        """Katz's discounts of counts up to 5, absolute ones where the counts of counts give none."""
        n = collections.Counter(counts.values())
        fixed = min(n[1] / (n[1] + 2 * n[2]), 0.9) if n[1] and n[2] else 0.5
        out = {r: 1 - fixed / r for r in range(1, 6)}
        common = 6 * n[6] / n[1]
        for r in out:
            if n[r] and common != 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                out[r] = x if 0.05 < x < 1 else out[r]
        return out

    d = {n: good_turing(count[n]) for n in range(1, order + 1)}

    def kept(g):
        c = count[len(g)][g]
        return d[len(g)][c] * c if c <= 5 else c - 0.001

    unknown = (total - sum(kept(g) for g in count[1])) / total
    after = collections.defaultdict(list)
    for n in range(2, order + 1):
        for g in count[n]:
            after[g[:-1]].append(g)
    alpha = {}

    def p(g):
        if len(g) == 1:
            return kept(g) / total if count[1][g] else unknown
        if count[len(g)][g]:
            return kept(g) / hist[g[:-1]]
        return (weight(g[:-1]) if hist[g[:-1]] else 1.0) * p(g[1:])

    def weight(h):
        if h not in alpha:
            alpha[h] = (1 - sum(kept(g) for g in after[h]) / hist[h]) / (1 - sum(p(g[1:]) for g in after[h]))
        return alpha[h]

    want = []
    for i, w in docs:
        s = sum(math.log10(p(w[max(k - order + 1, 0) : k + 1])) for k in range(1, len(w)))
        b = sum(math.log10((count[1][x,] + 1) / (total + len(count[1]) + 1)) for x in w[1:])
        want.append((-1 if i is None else i, held(i), len(w) - 1, sum(count[1][x,] > 0 for x in w[1:]), total, round(b, 4), round(s, 4)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in katz.score(df, order).collect()]
    assert sorted(got) == sorted(want)
    for h in [h for h in after if len(h) == order - 1][:40]:  # each history sums to one: seen words, unseen ones, unknown ones
        assert sum(p((*h, *g)) for g in count[1]) + weight(h) * p((*h[1:], b"?")) == pytest.approx(1)


def test_katz_repeated_blocks(spark, monkeypatch):
    """Blocks of the same rows in the same order: in two partitions, and one after another in one."""
    df = documents(spark)
    rows = lambda x: sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in katz.score(x).collect())
    want = rows(df.union(df).coalesce(1))
    assert rows(copies(spark, df)) == want
    import pandas as pd

    monkeypatch.setattr(katz, "BLOCK_TOKENS", 50)  # a long text fills a block alone
    batch = pd.DataFrame({"doc_id": [7, 7], "text": ["one two three four five " * 20] * 2})
    assert len({b.name for b in katz.blocks(iter([batch]))}) == 2


def test_katz_edges(spark):
    assert katz.score(empty(spark)).count() == 0
    assert katz.score(documents(spark)).count() == documents(spark).count()


# op10
def test_licenses(spark):
    text = licenses.TEMPLATES
    long = " ".join(f"w{i}" for i in range(500))
    rows = [
        (20, f"{long} {text['MIT-text'].upper()} {long}", "MIT-text"), (21, f"x\n{text['Apache-2.0']}.\ny", "Apache-2.0"), (22, text["MPL-2.0"].replace("This", "That"), "MPL-2.0"),
        (23, "under the license of nobody", ""), (24, " ".join(text["MIT-text"].split()[:20]), ""), (25, "Released under the\n\nMIT   License", "MIT"),
    ]
    df = documents(spark, [(i, t, "en", "a") for i, t, _ in rows])
    got = {r.doc_id: ",".join(r.licenses) for r in licenses.scan(df).collect()}
    assert {i: got[i] for i, _, _ in rows} == {i: x for i, _, x in rows}
    assert not any(v for k, v in got.items() if k is None or k < 20) and licenses.scan(empty(spark)).count() == 0
    docs = read(spark, "documents")
    found = {r.doc_id for r in licenses.scan(docs).collect() if r.licenses}
    assert found >= {r.doc_id for r in docs.where("text like '%Licensed under the Apache License, Version 2.0%'").collect()}


# ids
def test_large_ids_beside_nulls(spark):
    """Ids above 2**53 in a batch with null ids come back whole; so do other columns of a redacted table."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    big = [2**60 + 1, 2**60 + 3, -(2**61) - 7]
    rows = [(i, " ".join(f"w{(k + j) % 50}" for j in range(20 + k)), i) for k, i in enumerate([*big, None])] * 2
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string, other long")
    want = sorted([*big, -1] * 2)
    model = toxicity.Model()
    for made in (bpe.encode(df, path, P.PATTERN), bpe.encode(df, path, P.PATTERN, digests=True), toxicity.score(df, model), pii.find(df, pii.train(200)), neardup.group(df), katz.score(df)):
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in made.select("doc_id").collect()) == want
    out = [r.held_out for r in katz.score(df).collect()]
    assert sum(out) == sum(zlib.crc32(str(i).encode()) % 7 == 2 for i in big) * 2
    back = pii.redact(df, pii.train(200)).collect()
    assert sorted((-1 if r.other is None else r.other) for r in back) == want


def test_toxic_offsets_of_odd_letters():
    model = toxicity.Model(evidence={"idiot": 1}, emission=np.array([[0.0, -4.0], [0.0, 4.0]]), fitted=True)
    text = "İİ you idiot"
    assert [text[a:b] for a, b, _ in toxicity.score_text(model, text, {})[1]] == ["idiot"]


def test_pii_formats():
    model = pii.train()
    for text, want in {
        "host fe80::1 is up": "ip:5:12", "host 2001:db8::1:2 up": "ip:5:18", "call 5551234567 now": "phone:5:15", "mail john.doe at example.com please": "email:5:28",
        "write to ann@corp dot com": "email:9:25", "we look at example.com now": "", "time 12:30:45": "", "a::b": "", "order 5551234567": "",
    }.items():
        assert pii.spell(pii.added_spans(text, pii.base_spans(text), model)) == want, text
    assert len(pii.proposals("ring 020 7946 0958")) == 3  # overlapping proposals of one kind


def test_no_templates(spark):
    assert {tuple(r.licenses) for r in licenses.scan(documents(spark), {"short": "one two"}).collect()} == {()}
