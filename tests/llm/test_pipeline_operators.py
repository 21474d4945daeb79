"""Quality rules, line dedup, near-duplicates, packing, and the pipeline of all, against brute force."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from symdex.llm import line_dedup, packing, quality_rules, simhash
from symdex.llm.kernel import chunks

from .frames import LONG, ODD, docs, multiset, random_docs, with_clashes, words

BLANK = " \t\n\v\f\r"


def rows_of(df, *cols):
    return multiset(df.select(*cols).collect())


# line dedup


def plain_lines(rows):
    """(doc_id, text) after dedup; rows equal in id and text may stand for one another."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first = {}
    for i in order:
        for k, line in enumerate((rows[i][1] or "").split("\n")):
            if line.strip(BLANK) and line not in first:
                first[line] = (i, k)
    out = []
    for i, (doc, text) in enumerate(rows):
        if text is None:
            out.append((doc, text))
            continue
        lines = text.split("\n")
        kept = [x for k, x in enumerate(lines) if not x.strip(BLANK) or first[x] == (i, k)]
        if len(kept) == len(lines) or any(x.strip(BLANK) for x in kept):
            out.append((doc, "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("shard, held", [(line_dedup.SHARD_LINES, line_dedup.HELD_LINES), (100, 40)])
def test_line_dedup(spark, shard, held, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_LINES", shard)
    monkeypatch.setattr(line_dedup, "HELD_LINES", held)  # workers that are forked later see it; others hold all
    for seed in (1, 2):
        rows = random_docs(seed)
        assert rows_of(line_dedup.dedup(docs(spark, rows, 5)), "doc_id", "text") == plain_lines(rows)


def test_line_dedup_odd_rows(spark):
    odd = [r for r in ODD if r != (5, "different text under a known id")]
    df = with_clashes(docs(spark, odd))
    got = line_dedup.dedup(df)
    assert got.columns == df.columns and got.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    kept = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == plain_lines(odd)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["gone"] == df.first()["gone"] for r in kept)
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_documents_do_not_move(spark):
    rows = random_docs(3)
    got = line_dedup.dedup(docs(spark, rows))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # that of what is gone


def test_suspects_hold_every_repeat():
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, 300_000).astype(np.uint64)
    h[1000:1500], h[290_000:290_500] = h[:500], h[500:1000]
    hit = line_dedup.suspects(h)
    times = dict(zip(*(x.tolist() for x in np.unique(h, return_counts=True))))
    many = np.array([times[x] > 1 for x in h.tolist()])
    assert hit[many].all() and hit[~many].mean() < 0.01


def test_one_line_in_every_row_is_one_hash_for_a_task():
    rows = [(i, f"same\nown {i}") for i in range(5000)]
    uid, text = pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])
    sent = list(line_dedup._sent(3)([pa.RecordBatch.from_arrays([uid, text], ["uid", "text"])]))
    packed = {s: np.frombuffer(b, np.int64).reshape(-1, 2) for x in sent for s, b in zip(*x.to_pydict().values())}
    assert sum(len(v) for s, v in packed.items() if s < 3) == 5001 and sum(len(v) for s, v in packed.items() if s >= 3) == 5000


def test_line_dedup_without_repeats_changes_nothing(spark):
    rows = [(i, f"line {i}\n\nother {i}") for i in range(50)]
    assert rows_of(line_dedup.dedup(docs(spark, rows)), "doc_id", "text") == Counter(rows)


def test_no_repeated_line_escapes_the_filter(spark):
    rows = [(i, f"same\nown {i}") for i in range(40)]
    got = line_dedup.dedup(docs(spark, rows, 8)).collect()
    assert sum("same" in r["text"].split("\n") for r in got) == 1 and len(got) == 40


# quality rules


def plain_rejects(text):
    text = text or ""
    w = [x for x in re.split(r"[ \n\t\r]+", text) if x]
    share = lambda chars: sum(c in chars for c in text) / max(1, len(text))
    return (
        not w or share(quality_rules.SYMBOLS) > 0.03 or share(quality_rules.CAPITALS) > 0.34 or share("!") > 0.05 or len(text) > 40 * len(w)
        or sum(a == b for a, b in zip(w, w[1:])) > 0.2 * len(w) or len(set(w)) < 0.05 * len(w)
    )


def quality_rows(seed):
    r = random.Random(seed)
    made = [(i, words(r, r.randrange(1, 60), r.choice([1, 2, 50]))) for i in range(60)]
    made += [(100 + i, words(r, 30) + r.choice(["!", "#", "É", "A"]) * r.randrange(0, 40)) for i in range(40)]
    return made + [(200, "a" * 41), (201, "a" * 40), (202, "x x"), (203, "ÀÉ œuvre"), (204, LONG)] + ODD


def test_quality_rules(spark):
    rows = quality_rows(3)
    want = Counter(r for r in rows if not plain_rejects(r[1]))
    assert 0 < len(want) < len(rows)
    df = with_clashes(docs(spark, rows))
    got = quality_rules.keep(df)
    assert got.columns == df.columns and rows_of(got, "doc_id", "text") == want
    assert quality_rules.keep(df.limit(0)).count() == 0


def test_quality_order_follows_rejection_per_cost_and_never_changes_the_result(spark):
    rows = quality_rows(4)
    df = docs(spark, rows)
    ranked = quality_rules.order(df)
    worth = [share / max(cost, 1e-6) for _, share, cost in ranked]
    assert worth == sorted(worth, reverse=True) and len(ranked) == len(quality_rules.RULES)
    for rules in (quality_rules.RULES, quality_rules.RULES[::-1]):
        assert rows_of(quality_rules.keep(df, rules=rules, rows=10), "doc_id") == rows_of(quality_rules.keep(df), "doc_id")


def test_chunks_cut_rows_whole():
    texts = pa.array(["ab", None, "", "x" * 50, "é"])
    for limit in (1, 3, 1000):
        seen = [c.data[c.starts[k] : c.starts[k + 1]].tobytes().decode() for c in chunks(texts, limit) for k in range(c.rows)]
        assert seen == ["ab", "", "", "x" * 50, "é"]


def test_what_was_written_is_released(spark):
    from symdex.llm import scratch

    held, other = [], scratch.table(spark.range(3), "other")
    with scratch.noted(held):
        df = line_dedup.dedup(docs(spark, random_docs(5)))
    assert len(held) >= 3 and df.count() and any(t.name in scratch._named.values() for t in spark.catalog.listTables())
    before = set(scratch._named)
    paths = list(held)
    scratch.release(held)
    assert not held and not set(paths) & set(scratch._named) and before - set(scratch._named) <= set(paths) and other.count() == 3


# near duplicates


def plain_words(text):
    """Distinct features: lower-cased runs of ASCII letters, digits and other scripts; a wide character begins one."""
    out, run = set(), ""
    for c in text.lower() + " ":
        lead = c.encode()[0]
        inside = c.isascii() and c.isalnum() or lead >= 128
        if not inside or 0xE3 <= lead <= 0xED or 0xF0 <= lead <= 0xF4:
            out |= {run} - {""}
            run = ""
        run += c if inside else ""
    return out


def test_features():
    for text in ("The cat, the CAT; naïve 42", "日本語 ok", "", "!!", "😀😀x"):
        a = simhash.signatures(pa.array([text]))
        b = simhash.signatures(pa.array([" ".join(sorted(plain_words(text)))]))
        assert (a[0] == b[0]).all() and bool(a[1][0]) == bool(plain_words(text))


def plain_groups(words_):
    """Components of signatures by comparing all pairs."""
    n = len(words_)
    apart = np.bitwise_count(words_[:, None] ^ words_[None, :])
    near = ((apart <= simhash.RADIUS) & (np.roll(apart, -1, axis=2) <= simhash.CHECK_RADIUS)).any(axis=2) & (apart.sum(axis=2, dtype=int) <= simhash.TOTAL)
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(axis=1)
        if (new == label).all():
            return label
        label = new


def near_docs(seed, n=40):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"t{r.randrange(5000)}" for _ in range(r.randrange(80, 300))]
        rows.append((len(rows), " ".join(w)))
        for _ in range(r.choice([0, 0, 1, 3])):
            own = list(w)
            for _ in range(r.choice([0, 1, 3])):
                own[r.randrange(len(own))] = "edited"
            rows.append((len(rows), " ".join(own)))
    return rows


def test_masks_cover_every_difference_within_the_radius():
    m, r = simhash.masks(), np.random.default_rng(5)
    for _ in range(500):
        bits = r.choice(64, simhash.RADIUS, replace=False)
        d = np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64))
        assert (m & d == 0).any()
    for radius in (1, 2, 3):  # all differences of a small word
        from itertools import combinations

        m = simhash.masks(radius, 12)
        for bits in combinations(range(12), radius):
            d = np.uint64(sum(1 << b for b in bits))
            assert (m & d == 0).any()


@pytest.mark.parametrize("shard", [simhash.SHARD, 7])
def test_near_duplicates_are_the_components_of_all_pairs(spark, shard, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rows = near_docs(6)
    label = plain_groups(simhash.signatures(pa.array([t for _, t in rows]))[0])
    want = Counter((rows[i][0], int(k)) for i, k in enumerate(label) if i != k)
    assert len(want) > 10
    df = docs(spark, rows)
    assert rows_of(simhash.pairs(df), "doc_id", "duplicate_of") == want
    assert {r[0] for r in simhash.dedup(df).select("doc_id").collect()} == {r[0] for r in rows} - {i for i, _ in want}


def test_near_copies_are_found_and_others_left_alone(spark):
    r = random.Random(8)
    base = [[f"t{r.randrange(20_000)}" for _ in range(200)] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base[:30]):
        own = list(w)
        own[r.randrange(200)] = "changed"
        rows.append((100 + i, " ".join(own)))
    got = {(r["doc_id"], r["duplicate_of"]) for r in simhash.pairs(docs(spark, rows)).collect()}
    true = {(100 + i, i) for i in range(30)}
    assert len(got & true) >= 0.9 * len(true) and not got - true


def test_short_and_edited_copies_are_found(spark):
    r = random.Random(12)
    rows, true = [], set()
    for k, (n, edits) in enumerate([(50, 4), (60, 5), (100, 9), (140, 12)] * 25):  # word Jaccard 0.83 to 0.85
        w = [f"t{x}" for x in r.sample(range(50_000), n)]
        own = [f"new{k}x{i}" if i < edits else x for i, x in enumerate(w)]
        rows += [(k, " ".join(w)), (1000 + k, " ".join(own))]
        true.add((1000 + k, k))
    got = {(x["doc_id"], x["duplicate_of"]) for x in simhash.pairs(docs(spark, rows)).collect()}
    assert len(got & true) >= 0.9 * len(true) and not got - true


def test_one_word_alike_by_chance_is_not_near():
    apart = [(8, 16, 10, 10), (8, 16, 10, 11), (9, 9, 9, 9), (8, 17, 0, 0)]
    for bits, near in zip(apart, (True, False, False, False)):
        words_ = np.array([[0, (1 << n) - 1] for n in bits], np.uint64)
        assert (simhash.forest(words_, np.zeros(1, np.uint64))[1] == 0) == near


@pytest.mark.parametrize("n", [10, 10_000, 200_000, 14_000_000, 2_000_000_000])
def test_the_plan_covers_every_difference_within_the_radius(n):
    shards, groups = simhash.plan(n)
    assert (shards - 1) * simhash.SHARD < n <= shards * simhash.SHARD
    assert all(2 ** bin(agreed).count("1") >= 4 * shards / 2 for agreed, _ in groups)
    r = np.random.default_rng(n)
    for k in range(1500):
        width = simhash.RADIUS if k % 2 else int(r.integers(0, simhash.RADIUS + 1))
        near = r.integers(0, 64) if k % 3 else 0  # spread over the word, or close together
        bits = r.choice(64, width, replace=False) if k % 3 else (near + r.choice(20, width, replace=False)) % 64
        d = np.uint64(sum(1 << int(b) for b in bits))
        assert any(not int(d) & agreed and (masks & d == 0).any() for agreed, masks in groups)


@pytest.mark.parametrize("large", [1, simhash.LARGE])
def test_a_forest_has_the_components_of_all_pairs(large, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", large)
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 62, (5, simhash.WORDS)).astype(np.uint64)
    words_ = base[r.integers(0, 5, 300)]
    for _ in range(7):
        flip = r.integers(0, 64, words_.shape).astype(np.uint64)
        words_ ^= (r.random(words_.shape) < 0.6).astype(np.uint64) << flip
    words_ = np.unique(words_, axis=0)
    own = words_.T
    apart = np.bitwise_count(own[:, :, None] ^ own[:, None, :])
    near = (apart[0] <= simhash.RADIUS) & (apart[1] <= simhash.CHECK_RADIUS) & (apart.sum(axis=0, dtype=int) <= simhash.TOTAL)
    i, j = np.nonzero(near)
    want = simhash.components(len(words_), i, j)
    assert 5 <= len(set(want.tolist())) < len(words_)
    for table in ([np.uint64(0)], simhash.masks()):
        assert (simhash.forest(np.ascontiguousarray(own), np.array(table, np.uint64)) == want).all()


def test_a_group_of_alike_texts_costs_about_its_size():
    r = np.random.default_rng(4)
    n = 60_000
    words_ = np.repeat(r.integers(0, 1 << 62, (simhash.WORDS, 1)).astype(np.uint64), n, axis=1)
    for _ in range(3):
        words_ ^= np.uint64(1) << r.integers(0, 64, words_.shape).astype(np.uint64)
    began = time.perf_counter()
    label = simhash.forest(words_, np.array([0, 0xFFFFFFFF, 1 << 40], np.uint64))
    assert (label == 0).all() and time.perf_counter() - began < 20  # all pairs would be 1.8e9


def test_signatures_of_a_long_text_count_every_feature():
    texts = [" ".join(f"v{i}" for i in range(n)) for n in (1, 254, 255, 256, 1000, 5000)]
    from symdex.llm.kernel import U64, mix, runs

    got = simhash.signatures(pa.array(texts))[0]
    for text, word in zip(texts, got):
        c = next(chunks(pa.array([text])))
        s, e = runs(c, simhash._WORD[c.data])
        f = np.unique(c.hashes(s, e) >> U64(20))
        for k, seed in enumerate(simhash._SEEDS):
            h = mix(f ^ U64(seed))
            ones = ((h[:, None] >> np.arange(64, dtype=U64)) & U64(1)).sum(axis=0)
            assert int(word[k]) == sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(f)))


def test_near_duplicates_odd_rows(spark):
    df = with_clashes(docs(spark, ODD))
    got = simhash.dedup(df)
    assert got.columns == df.columns
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    alike = {"Two lines.\nOther.", "Other.\nTwo lines."}
    want = Counter(ODD) - Counter([(4, ODD[3][1])]) - Counter([(11, "Other.\nTwo lines.")])
    assert alike & {t for _, t in kept} == {"Two lines.\nOther."} and kept == want
    assert simhash.dedup(df.limit(0)).count() == 0 and simhash.pairs(df.limit(0)).count() == 0
    assert rows_of(simhash.pairs(df), "doc_id", "duplicate_of") == Counter([(4, 4), (11, 5)])


def test_a_chain_of_components():
    r = np.random.default_rng(1)
    for n, m in ((50, 40), (200, 150)):
        a, b = r.integers(0, n, m), r.integers(0, n, m)
        label = simhash.components(n, a, b)
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(a, b):
            p, q = sorted((find(x), find(y)))
            parent[q] = p
        assert label.tolist() == [find(x) for x in range(n)]


def test_connect(spark):
    r = random.Random(2)
    pairs = {(max(p), min(p)) for p in ((r.randrange(300), r.randrange(300)) for _ in range(220)) if p[0] != p[1]} | {(1000 + i + 1, 1000 + i) for i in range(60)}
    got = dict(map(tuple, simhash.connect(spark.createDataFrame(sorted(pairs), "u bigint, v bigint")).collect()))
    names = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(names)}
    label = simhash.components(len(names), np.array([at[u] for u, _ in pairs]), np.array([at[v] for _, v in pairs]))
    want = {x: names[label[at[x]]] for x in names}
    assert all(got.get(x, x) == want[x] for x in names)


# packing


def plain_pack(lengths, capacity):
    """Best-fit decreasing, piece by piece: the spaces left in the bins."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = min((b for b in range(len(bins)) if bins[b] >= n), key=lambda b: bins[b], default=None)
        if fit is None:
            bins.append(capacity)
            fit = len(bins) - 1
        bins[fit] -= n
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 50, 128])
    lengths = [r.randrange(1, capacity + 1) if r.random() < 0.7 else r.choice([1, 2, capacity]) for _ in range(r.randrange(1, 400))]
    rows = packing.plan(Counter(lengths), capacity)
    used, taken = defaultdict(list), Counter()
    assert len(rows) <= packing.plan_bound(capacity)
    for length, lo, hi, first, bins, at in rows:
        taken[length] += hi - lo
        for k in range(hi - lo):
            used[first + k % bins].append((at + length * (k // bins), length))
    assert taken == Counter(lengths)
    for own in used.values():  # pieces stand one after another, within the capacity
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(used) == list(range(len(used)))
    assert Counter(capacity - sum(n for _, n in own) for own in used.values()) == Counter(plain_pack(lengths, capacity))


def plain_pieces(rows, capacity):
    out = []
    for doc, text in rows:
        spans = [m.span() for m in re.finditer(r"[^ \t\n\v\f\r]+", text or "")]
        for k in range(0, len(spans), capacity):
            own = spans[k : k + capacity]
            out.append((doc, k // capacity, len(own), text[own[0][0] : own[-1][1]]))
    return out


def test_a_plan_stays_within_its_bound():
    r = random.Random(5)
    for capacity in (2, 3, 64, 2048):
        for _ in range(5):
            histogram = {n: r.choice([1, 2, 7, 10**6, r.randrange(1, 10**9)]) for n in range(1, capacity + 1) if r.random() < 0.9}
            assert len(packing.plan(histogram, capacity)) <= packing.plan_bound(capacity)


@pytest.mark.parametrize("bucket", [packing.BUCKET, 5])
def test_packing(spark, bucket, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", bucket)
    r = random.Random(4)
    rows = [(i, words(r, r.choice([0, 1, 5, 20, 21, 45, 130]))) for i in range(80)] + ODD
    df = with_clashes(docs(spark, rows))
    got = packing.pack(df, capacity=20).collect()
    pieces = plain_pieces(rows, 20)
    assert Counter((x["doc_id"], x["piece"], x["n_words"], x["text"]) for x in got) == Counter(pieces)
    fill = defaultdict(list)
    for x in got:
        fill[x["bin_id"]].append((x["bin_offset"], x["n_words"]))
    for own in fill.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 20
    assert len(fill) == len(plain_pack([p[2] for p in pieces], 20)) and sorted(fill) == list(range(len(fill)))
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_is_deterministic(spark):
    rows = [(i, "a b c") for i in range(30)] + [(i, "d e") for i in range(30)]
    one = rows_of(packing.pack(docs(spark, rows, 1), capacity=8), "bin_id", "bin_offset", "doc_id", "text")
    assert one == rows_of(packing.pack(docs(spark, rows, 5), capacity=8), "bin_id", "bin_offset", "doc_id", "text")


# the pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, t) for i, t in near_docs(10, 15)] + [(500 + i, "shared passage of words here\n" + words(r, 30, 4000)) for i in range(8)] + [(600, None), (601, "!!! !!!"), (602, ""), (603, rows_text := words(r, 40, 3000)), (604, rows_text)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = [x for x in rows if not plain_rejects(x[1])]
    lines = sorted(plain_lines(good).elements(), key=lambda x: x[0])
    label = plain_groups(simhash.signatures(pa.array([t for _, t in lines]))[0])
    left = [x for x, (k, m) in zip(lines, enumerate(label)) if k == m]
    pieces = plain_pieces(left, packing.CAPACITY)
    assert len(good) < len(rows) and len(left) < len(lines)
    assert Counter((x["doc_id"], x["piece"], x["n_words"], x["text"]) for x in got) == Counter(pieces)
    assert len({x["bin_id"] for x in got}) == len(plain_pack([p[2] for p in pieces], packing.CAPACITY))


def test_every_stage_but_the_last_returns_documents(spark, sf_dir):
    docs_ = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs_, sf_dir)
        assert out.columns == docs_.columns and 0 < out.count() < docs_.count()
    assert {"doc_id", "bin_id"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs_.limit(5), sf_dir).columns)


@pytest.mark.parametrize("rows", [[], [(1, None)], ODD])
def test_stages_take_odd_tables(spark, rows, tmp_path):
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["text"] for r in got) and (got or rows != ODD)
