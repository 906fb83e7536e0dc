import random
from itertools import combinations

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from oracle import compare
from pyspark.sql import functions as F

from syndrift.llm import chat, decontam, licenses, minhash, mixing, queries, repetition, secret_scan, textnum, token_counts, url_filter
from syndrift.llm.store import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return brute.documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name], SF)


def docs_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# ---- words and hashes


@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_words(texts):
    texts = [None if t is None else t.encode("utf-8", "replace").decode() for t in texts]
    buf, offs = textnum.pack(pa.array(texts, pa.string()))
    for between, split in ((textnum.SPACE, brute.spaces), (textnum.MARKS, lambda t: brute.re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or ""))):
        s, e, n = textnum.words(buf, offs, between)
        assert n.tolist() == [len(split(t)) for t in texts]
        assert [bytes(buf[a:b]).decode() for a, b in zip(s, e, strict=True)] == [w for t in texts for w in split(t)]
        h = textnum.hashes(buf, s, e, textnum.LOWER)
        words = [w.translate(brute.LOWER) for t in texts for w in split(t)]
        assert len({(w, int(x)) for w, x in zip(words, h, strict=True)}) == len(set(words)) == len(set(h.tolist()))


def test_hash_free_of_place(monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(4000))
    buf, offs = textnum.pack(pa.array([text]))
    s, e, _ = textnum.words(buf, offs, textnum.SPACE)
    whole = textnum.hashes(buf, s, e)
    monkeypatch.setattr(textnum, "SPAN", 100)
    monkeypatch.setattr(textnum, "_POWERS", {})
    assert np.array_equal(whole, textnum.hashes(buf, s, e)) and len(set(whole.tolist())) == 50


# ---- 1 decontamination


def test_contamination(spark, docs, rows):
    items = [(1, brute.BENCH), (2, "one two three"), (20, "Three four"), (3, ""), (4, None), (None, "a"), (5, brute.BENCH + " again")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    want = brute.contamination(rows, [x for x in items if x[0] is not None])
    for block in (decontam.BLOCK_CHARS, 60):
        got = decontam.report(decontam.contamination(docs, bench, Scratch(spark, "t"), block_chars=block)).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want
        assert len(got) == len(rows)
    assert decontam.contamination(docs.limit(0), bench, Scratch(spark, "t")).count() == 0
    none = decontam.report(decontam.contamination(docs, bench.limit(0), Scratch(spark, "t")))
    assert none.agg(F.sum("n_hit")).first()[0] == 0


def test_proximity(spark):
    texts = [(1, "a b c d e"), (2, "c x b"), (3, "a c"), (4, "b c b c"), (5, None)]
    index = decontam.build_index(spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1), Scratch(spark, "t"))
    got = {(r.doc_id, r["first"], r["last"]) for r in decontam.find_near(index, {9: ["B", "c"]}, 3).collect()}
    want = set()
    for i, t in texts:
        w = brute.marks(t)
        spans = {(a, b) for a in range(len(w)) for b in range(a, min(a + 3, len(w))) if {"b", "c"} <= set(w[a : b + 1])}
        want |= {(i, a, b) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)}
    assert got == want


def test_proximity_folds_as_the_index(spark):
    index = decontam.build_index(spark.createDataFrame([(1, "École Ünder ZWEI"), (2, "école zwei")], "doc_id bigint, text string"), Scratch(spark, "t"))
    found = decontam.find_near(index, {1: ["École", "zwei"], 2: ["école", "ZWEI"]}, 5)
    assert {(r.doc_id, r.query_id) for r in found.collect()} == {(1, 1), (2, 2)}


# ---- 2 chat formatting


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "odd: role", "", "@x", "a\n###"]), st.text(alphabet="\\#</turn>: aé\n@", max_size=30)), max_size=6))
def test_chat_round_trip(turns):
    t = chat.Template()
    assert t.parse("".join(s for s, _ in t.segments(turns))) == turns


def test_chat_machine(spark):
    t = chat.Template()
    assert t.violation(["system", "user", "assistant"]) is None and t.violation(["user", "assistant", "tool", "assistant"]) is None
    assert t.violation(["user", "user"]) == "1: user after user" and t.violation(["user"]) == "1: ends after user"
    assert t.violation(["bot"]).startswith("0: unknown") and t.violation([]) is not None
    rows = [(1, 1, "assistant", "yes </turn>"), (1, 0, "user", None), (None, 0, "user", "x"), (2, None, None, "n"), (2, 0, "user", "u"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("valid", F.lit("clash"))
    got = {r.conv_id: r for r in chat.report(chat.format_chats(df)).collect()}
    assert got[1].turns_sha256 == brute.sha("user\n\nassistant\nyes </turn>\n") and got[1].loss_sha256 == brute.sha("yes </turn>") and got[1].valid
    assert got[2].n_turns == 2 and got[2].turns_sha256 == brute.sha("\nn\nuser\nu\n") and got[3].n_turns == 2 and not got[3].valid
    assert got[None].n_turns == 1 and chat.format_chats(df.limit(0)).count() == 0
    mask = chat.format_chats(df).where("conv_id = 1").first()
    assert [mask.text[s.start : s.end] for s in mask.segments if s.loss] == ["yes \\</turn>"]


# ---- 3 token counts


def test_token_counts(spark, docs, rows):
    import tiktoken

    ranks, pattern = token_counts.vocabulary()
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    lens = [len(enc.encode_ordinary(t or "")) for _, t in rows]
    got = token_counts.answers(token_counts.histogram(docs)).orderBy("length").collect()
    assert {r.length: r.n_docs for r in got} == {n: lens.count(n) for n in lens}
    for r in got:
        assert r.docs_within == sum(n <= r.length for n in lens) and r.docs_over == sum(n > r.length for n in lens)
        assert r.tokens_within == sum(n for n in lens if n <= r.length) and r.tokens_over == sum(n for n in lens if n > r.length)
        assert r.tokens_cut_to == sum(min(n, r.length) for n in lens)
    held = token_counts.answers(token_counts.histogram(docs))
    for limit in (0, 3, 50, 10**6):
        assert token_counts.at_limit(held, limit)["tokens_cut_to"] == sum(min(n, limit) for n in lens)
    assert token_counts.quantile(held, 0.5) == sorted(lens)[-(-len(lens) // 2) - 1]
    assert token_counts.answers(token_counts.histogram(docs.limit(0))).count() == 0


# ---- 4 quality rules


def _share(w: list[str], k: int) -> float:
    seen, inside = set(), set()
    for i in range(len(w) - k + 1):
        g = tuple(w[i : i + k])
        if g in seen:
            inside |= set(range(i, i + k))
        seen.add(g)
    return sum(len(w[i]) for i in inside) / max(sum(map(len, w)), 1)


def test_repetition(docs, rows):
    got = repetition.verdict(repetition.repetition(docs)).collect()
    assert len(got) == len(rows)
    want = dict(rows)
    for r in got:
        t, w = want[r.doc_id] or "", brute.spaces(want[r.doc_id])
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = {g for g in set(three) if three.count(g) > 1} if len(w) < 2000 else None
        lines = [x for x in t.split("\n") if brute.spaces(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        if many is not None:
            assert r.n_repeat_words == len({j for i, g in enumerate(three) if g in many for j in range(i, i + 3)})
        for k in repetition.ALL_NGRAMS:
            assert r[f"dup_{k}gram"] == pytest.approx(_share(w, k))
        for k in repetition.TOP_NGRAM if len(w) < 2000 else ():
            g = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            top = max((g.count(x) * len("".join(x)) for x in set(g) if g.count(x) > 1), default=0)
            assert r[f"top_{k}gram"] == pytest.approx(min(top / max(sum(map(len, w)), 1), 1))
        assert r.base_failed == (len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w)) and not (r.kept and r.base_failed)
    assert repetition.repetition(docs.limit(0)).count() == 0


# ---- 5 near-duplicates


def test_near_duplicates(spark, docs, rows):
    want = brute.near_groups(list(dict(rows).items()))
    got = minhash.report(minhash.near_duplicates(docs, Scratch(spark, "t"))).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want
    sizes = {i: len(brute.shingles(t)) for i, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(docs.limit(0), Scratch(spark, "t")).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (4, "a b c d e f g")], "doc_id bigint, text string")
    assert sorted((r.component_id or -1, r.kept) for r in minhash.report(minhash.near_duplicates(nulls, Scratch(spark, "t"))).collect()) == [(-1, True), (-1, True), (4, True)]


def test_large_family_in_blocks(spark, monkeypatch):
    rng, base = random.Random(3), [f"b{i}" for i in range(80)]
    texts = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK", 40)
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, Scratch(spark, "t")).collect()}
    assert got == brute.near_groups(texts)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    assert got == {r.doc_id: r.component_id for r in minhash.near_duplicates(df, Scratch(spark, "t")).collect()}


def test_family_of_many_members_moves_each_set_a_few_times(spark, monkeypatch):
    """Copies of one text, each with a word of its own: what is dealt to tasks follows the members, not their pairs."""
    base, rng, n = [f"b{i}" for i in range(100)], random.Random(4), 20_000
    hub = 17_345
    texts = [(i, " ".join(base if i == hub else base[: (at := rng.randrange(100))] + [f"z{i}"] + base[at + 1 :])) for i in range(n)]
    moved = []

    def counted(*args, own=minhash.dealt):
        moved.append(own(*args).count())
        return own(*args)

    monkeypatch.setattr(minhash, "dealt", counted)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"), Scratch(spark, "t")).collect()}
    # every copy is linked with the text itself, so all are one group
    assert set(got.values()) == {0} and len(got) == n and moved[0] <= 2 * n


def test_mixed_family_equals_brute_force(spark, monkeypatch):
    """A large component, small ones and texts of other lengths that only share bands with it."""
    rng, base, texts = random.Random(12), [f"b{i}" for i in range(100)], []
    for i in range(260):
        w = list(base[: rng.choice([100, 100, 100, 92, 80])])
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"z{rng.randrange(40)}"
        texts.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    want = brute.near_groups(texts)
    assert len(set(want.values())) > 10
    for block, size in ((512, 4 << 20), (16, 4 << 20), (512, 5000)):
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "BLOCK_BYTES", size)
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, Scratch(spark, "t")).collect()} == want


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    sets = [a, np.concatenate([a[:1700], rng.integers(0, 2**63, 300).astype(np.uint64)]), a[:1], a[:6]]
    s = minhash.sketch(np.concatenate(sets), np.array([len(x) for x in sets]), 560)
    assert (s != minhash.FULL).all() and abs((s[0] == s[1]).mean() - 1700 / 2300) < 0.08
    assert np.array_equal(s[0], minhash.sketch(a, np.array([2000]), 560)[0])
    keys = minhash.band_keys(s, 56)
    assert keys.shape == (4, 56) and (keys[0] == keys[1]).any()


def test_links_agree():
    rng = random.Random(5)
    sets = [np.unique(np.array([rng.randrange(40) for _ in range(rng.randrange(1, 60))], np.uint64)) for _ in range(60)]
    got = minhash.links(sets)
    for i, j in combinations(range(60), 2):
        x, y = set(sets[i].tolist()), set(sets[j].tolist())
        assert got[i, j] == (100 * len(x & y) >= 85 * len(x | y)) == minhash.links([sets[i], sets[j]])[0, 1]


def test_components(spark):
    rng = random.Random(2)
    for edges in ([(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(rng.randrange(50), rng.randrange(50)) for _ in range(35)], []):
        df = spark.createDataFrame(edges, "a bigint, b bigint")
        want = brute.components({(a, b) for a, b in edges if a != b}, {x for e in edges if e[0] != e[1] for x in e})
        assert {r.node: r.component for r in minhash.components(df, Scratch(spark, "t"), "e").collect()} == want


# ---- 6 secret scans


def test_secrets(spark, docs, rows):
    model = secret_scan.trained(spark.read.parquet(f"{SF}/documents.parquet"))
    got = secret_scan.report(secret_scan.scan(docs, model)).collect()
    assert len(got) == len(rows)
    want = dict(rows)
    for r in got:
        base = brute.secrets(want[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base)
        assert r.base_sha256 == brute.sha(text) and [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in base) for k in range(3)]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    spans = {r.doc_id: r.spans for r in got}
    assert spans[21] == "random:4:28"
    whole = [r for r in docs_of(spark, SF)]
    found = {r.doc_id: r for r in queries.QUERIES["op6_secret_scans"](spark, SF).collect()}
    for i, t in whole:
        assert found[i].base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in brute.secrets(t)))
    assert secret_scan.scan(docs.limit(0), model).count() == 0


def test_markov_models(spark, docs):
    model = secret_scan.trained(spark.read.parquet(f"{SF}/documents.parquet"))
    tokens = [("r", "q8ZkP2xVn4TtLw9eYb3R"), ("r", "0f9d3e7a61bc4488de02"), ("o", "user_profile_settings"), ("o", "theHashOfThoustion12")]
    df = spark.createDataFrame(tokens, "label string, token string").withColumn("s", secret_scan.log_odds(F.col("token"), model))
    assert all((r.s > 0) == (r.label == "r") for r in df.collect())


def test_mask(spark, docs, rows):
    got = {r.doc_id: r for r in secret_scan.mask(docs).collect()}
    assert got[19].text == "secret:token:abcdefgh [REDACTED:assign]' api-key" and got[0].text is None and got[4].text == "one two three four"
    assert got[28].text == "😀" * 20 + " [REDACTED:assign]" and secret_scan.mask(docs).columns == docs.columns
    clash = docs.withColumnsRenamed({"spans": "_text", "lang": "_base", "source": "_row"})
    assert sorted(map(repr, secret_scan.mask(clash).select("_text", "_base", "_row", "doc_id").collect())) == sorted(map(repr, clash.select("_text", "_base", "_row", "doc_id").collect()))


# ---- 7 mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert mixing.targets([0, 5], [5, 1]) == [0.0, 5.0] and mixing.targets([], []) == []


@pytest.mark.parametrize("point", [mixing.golden, mixing.van_der_corput])
@pytest.mark.parametrize("block", [None, 7, 10_000])
def test_mixing(spark, docs, rows, point, block):
    got = mixing.mix(docs, Scratch(spark, "t"), point=point, block=block).collect()
    assert len(got) == len(rows)
    by = {}
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in got:
        by.setdefault(source[r.doc_id], []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    words = sum(r.size for r in got)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = mixing.targets([sum(r.size for r in by[s]) for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))])
    for s, t in zip(order, want, strict=True):
        assert by[s][0].target == t and sum(r.taken for r in by[s]) == round(t) and by[s][0].source_size == sum(r.size for r in by[s])
    assert abs(sum(r.taken for r in got) - words) <= len(order)


def test_mixing_edges(spark, docs):
    assert mixing.mix(docs.limit(0), Scratch(spark, "t")).count() == 0
    nothing = docs.where("doc_id in (0, 1, 2)")
    assert [r.taken for r in mixing.mix(nothing, Scratch(spark, "t")).collect()] == [0] * nothing.count()


def test_schedule_is_even(spark):
    sources = [{"sid": i, "target": t, "slots": n} for i, (t, n) in enumerate([(500.0, 500), (300.0, 300), (200.0, 200), (0.5, 1)])]
    rows = mixing.schedule(spark, sources).collect()
    for upto in (50, 200, 700):
        own = [r.sid for r in rows if r.slot < upto]
        assert all(abs(own.count(i) / len(own) - s["target"] / 1000.5) < 0.03 for i, s in enumerate(sources))
    all_ = mixing.schedule(spark, sources).collect()
    assert {i: sorted(r["rank"] for r in all_ if r.sid == i) for i in range(4)} == {i: list(range(s["slots"])) for i, s in enumerate(sources)}


@pytest.mark.parametrize("point", [mixing.golden, mixing.van_der_corput])
def test_every_slot_is_in_the_schedule(spark, point):
    """Sources of a few words beside one of nearly all."""
    for sizes in ([1], [1, 1], [9_000, 1, 1, 2, 1], [1] * 300, [5_000, *range(1, 40)]):
        got = mixing.schedule(spark, [{"sid": i, "target": 0.01 if n == 1 else float(n), "slots": n} for i, n in enumerate(sizes)], point).collect()
        ranks = {}
        for r in sorted(got, key=lambda r: r.slot):
            ranks.setdefault(r.sid, []).append(r["rank"])
        assert ranks == {i: list(range(n)) for i, n in enumerate(sizes)} and len({r.slot for r in got}) == sum(sizes)


# ---- 8 URL filters

URLS = [
    (0, "https://a.example.com/en/1"), (1, "http://EXAMPLE.com/en/7x?q"), (2, "x://shop.example.net/de/8"), (3, "x://net/de/9#f"), (4, "noscheme/en/"), (5, None), (6, ""),
    (7, "ftp://u:p@Foo.ORG/es/a://b"), (8, "http://notcom/en/"), (9, "http://com/en/"), (10, "http://com"), (11, "http://ÀB.com/en/é"), (3, "x://net/de/9#f"),
]


def _fixed(url):
    m = brute.re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(brute.LOWER), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.FIXED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_fixed_rules(spark):
    pages = spark.createDataFrame([(*u, "h") for u in URLS], "page_id bigint, url string, host string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge(pages).collect())
    assert got == sorted((i, *_fixed(u)[:2], _fixed(u)[2] or "", _fixed(u)[3] or "allow") for i, u in URLS)
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_mined_rules(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        site, part, key = rng.choice("abc"), rng.choice(["x", "y"]), rng.choice(["ref", "id"])
        rows.append((i, f"https://{site}.test/{part}/{rng.randrange(100, 999)}?{key}=1"))
        labels.append((i, 1, int(site == "a" and key == "ref" or rng.random() < 0.02)))
    pages, marks = spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    mined = url_filter.mine(pages, marks, Scratch(spark, "t"), min_support=0.02, min_confidence=0.6)
    sets = {r.page_id: set(r.t) for r in pages.select("page_id", url_filter.tokens(F.col("url")).alias("t")).collect()}
    bad = {i for i, _, t in labels if t}
    rate = len(bad) / len(rows)
    # tokens of the same pages count as one
    on = {}
    for t in {t for s in sets.values() for t in s}:
        on.setdefault(frozenset(i for i, s in sets.items() if t in s), []).append(t)
    first = {min(ts, key=lambda t: (len(t), t)) for ts in on.values()}
    every = {}
    for k in range(1, len(first) + 1):
        for items in {frozenset(c) for s in sets.values() for c in combinations(sorted(s & first), k)}:
            has = [i for i, s in sets.items() if items <= s]
            both = sum(i in bad for i in has)
            if both >= 20 and both / len(has) >= 0.6 and both / len(has) - rate >= url_filter.MIN_Z * (rate * (1 - rate) / len(has)) ** 0.5:
                every[items] = both / len(has)
    pruned = {k: v for k, v in every.items() if not any(o < k and w >= v for o, w in every.items())}
    assert {frozenset(r["items"]): pytest.approx(r["confidence"]) for r in mined.collect()} == pruned and frozenset({"h:a", "q:ref"}) in pruned
    want = {i: "block" if any(k <= s for k in pruned) else "allow" for i, s in sets.items()}
    told = [sorted(map(tuple, url_filter.judge(pages, mined, most).collect()), key=repr) for most in (url_filter.MAX_BROADCAST, 0)]
    assert {r[0]: r[4] for r in told[0]} == want and told[0] == told[1] and "block" in want.values()
    assert url_filter.mine(pages, marks.limit(0), Scratch(spark, "t")).count() == 0 and url_filter.mine(pages.limit(0), marks, Scratch(spark, "t")).count() == 0


def test_redundant_rules_do_not_crowd_out_others(spark):
    """Long combinations of one site collapse to one rule, and a rule that needs five tokens is found."""
    rng, rows, labels = random.Random(8), [], []
    for i in range(900):
        own = [rng.random() < 0.75 for _ in range(5)]
        site = "/".join(f"part{'abcdefghij'[k]}" for k in range(8)) if i % 9 == 0 else "".join(f"{'vwxyz'[k]}/" for k in range(5) if own[k])
        rows.append((i, f"https://{'bad' if i % 9 == 0 else 'mix'}.test/{site}"))
        labels.append((i, None if i % 2 else 1, int(i % 9 == 0 or all(own))))
    pages, marks = spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    mined = [set(r["items"]) for r in url_filter.mine(pages, marks, Scratch(spark, "t")).collect()]
    assert {"p:v", "p:w", "p:x", "p:y", "p:z"} in mined and sum(any(t.startswith("p:part") or t == "h:bad" or t.startswith("d:bad") for t in m) for m in mined) == 1


def test_labels_that_do_not_depend_on_urls_give_no_rules(spark):
    rng = random.Random(9)
    rows = [(i, f"https://{rng.choice(['www', 'blog'])}.s{rng.choice('abcd')}.test/{rng.choice('xyz')}/{rng.randrange(999)}?{rng.choice(['ref', 'id'])}=1") for i in range(1000)]
    pages = spark.createDataFrame([*rows, (5000, "http://" + "very/long/" * 50_000), (None, "http://a.b/c")], "page_id bigint, url string")
    for share in (0.0, 0.1, 0.7, 1.0):
        marks = spark.createDataFrame([(i, 1, int(rng.random() < share)) for i, _ in rows], "doc_id bigint, quality int, toxic int")
        rules = url_filter.mine(pages, marks, Scratch(spark, "t"))
        assert rules.count() == 0 and url_filter.judge(pages, rules).where("verdict = 'block'").count() == 0
    nothing = spark.createDataFrame([(i, None, None) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    assert url_filter.mine(pages, nothing, Scratch(spark, "t")).count() == 0


# ---- 10 license scans


def _detections(words: list[str], known: list[dict]) -> list[tuple]:
    norm, found = " " + " ".join(words) + " ", []
    for r in known:
        for m in brute.re.finditer(r["regex"], norm):
            a, b = norm[: m.start()].count(" ") - 1, norm[: m.end()].count(" ")
            found.append((a, -b, -r["priority"], r["no"], r["label"], r["score"]))
    inside = lambda x, y: y[0] <= x[0] and y[1] <= x[1] and (y[2], y[0] - x[0], y[1] - x[1], y[3]) < (x[2], 0, 0, x[3])
    return sorted(x for x in found if not any(inside(x, y) for y in found))


def test_licenses(spark, docs, rows):
    known = licenses.rules()
    assert len(known) > 300 and len({r["regex"] for r in known}) > 300
    for data, pairs in ((docs, rows), (spark.read.parquet(f"{SF}/documents.parquet"), docs_of(spark, SF))):
        want = dict(pairs)
        got = licenses.report(licenses.scan(data)).collect()
        assert len(got) == len(pairs)
        for r in got:
            w = brute.marks(want[r.doc_id])
            base = sorted((i, name) for p, name in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
            found = _detections(w, known) if len(w) < 5000 else []
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None)
            assert r.base_labels == ",".join(sorted({n for _, n in base})) and r.labels == ",".join(sorted({n for _, n in base} | {x[4] for x in found}))
            assert r.score == max([x[5] for x in found] + [licenses.BASE_SCORE if base else 0.0])
    assert licenses.scan(docs.limit(0)).count() == 0


def test_more_specific_license_wins(spark):
    texts = ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: MPL", "licensed under the GNU General Public License, version 3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in licenses.report(licenses.scan(df)).collect()}
    assert got[0] == "apache,apache-2.0" and "gpl-3.0" in got[2].split(",")
