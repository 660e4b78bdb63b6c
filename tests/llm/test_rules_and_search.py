"""Quality rules, url filter, personal data, exact search, mixing and toxicity against brute force and on edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import make
from labelloom.llm import pii, quality, toxicity, urls
from labelloom.llm.mixing import mix_documents, mix_table
from labelloom.llm.topk import best_in_block, matrix, pivot_distances, top_inner_products

SYMBOLS = "#*$%&|<>"


def slow_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i: i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in SYMBOLS for c in text), len(lines) - len(set(lines)), len(lines), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #*|é\n\t\x0b　𝔘", max_size=120))
def test_measures(text):
    assert quality.measures(text.encode()) == slow_measures(text)


def test_repeated_words_rename_when_codes_grow():
    words = [str(i).encode() for i in range(9000)] + [b"1", b"2", b"3", b"4", b"5"]
    assert quality.repeated_words(words) == 10


def test_sketch_buckets(spark):
    values = [*range(0, 300), 1000, 4095, 4096, 10**6, 10**9]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality.bucket(quality.F.col("v")).alias("b")).collect()]
    for v, b in zip(values, got):
        assert b <= v and (v < 128 and b == v or v - b <= v / 64)


def test_quality_thresholds_and_edges(spark, edge_docs, edge_rows):
    got = quality.quality_table(edge_docs).collect()
    assert len(got) == len(edge_rows)
    want = sorted(slow_measures(t or "")[:4] for _, t, _ in edge_rows)
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.quality_table(make(spark, [])).count() == 0
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(40)), "s") for i in range(60)]
    rows.append((99, " ".join(f"w{i}&&&" for i in range(40)), "s"))
    kept = {r.doc_id: r.kept for r in quality.quality_table(make(spark, rows)).collect()}
    assert not kept[99] and sum(kept.values()) == 60


def brute_spans(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2]), s[1]))


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet="a14.@+-( )%é0 ", max_size=50) | st.lists(st.sampled_from(["4111 1111 1111 1111", "1.2.3.4", "999.1.1.1", "a@b.c", "+1 (771) 555-1655", " ", ".", "-", "5"]), max_size=8).map("".join))
def test_plain_spans(text):
    assert pii.plain_spans(text) == brute_spans(text)


@pytest.mark.parametrize("text,start,end,kind", [
    ("to jo＠mail.com x", 3, 14, "email"), ("john (at) mail (dot) com", 0, 24, "email"), ("mail anna at mail5 dot example dot org now", 5, 38, "email"),
    ("jоhn.d@exa​mple.com", 0, 19, "email"), ("call plus one two three four five six seven eight nine zero!", 5, 59, "phone"),
    ("١٩٢.168.1.1", 0, 11, "ip"), ("bob [at] host.example.org", 0, 25, "email"), ("four one one one one one one one one one one one one one one one", 0, 64, "card")])
def test_hidden_spans_map_to_the_source(text, start, end, kind):
    assert (start, end, kind) in pii.find_spans(text)[1]


@pytest.mark.parametrize("text,kind", [
    ("192 dot 168 dot 1 dot 10", "ip"), ("192[.]168[.]1[.]10", "ip"), ("one nine two dot one six eight dot zero dot one", "ip"), ("john.smith at gmail.com", "email"),
    ("call <four one five 555 two six seven one>", "phone"), ("<4 1 5 five five five two six seven one>", "phone"), ("<plus four four 20 seven nine four four six 0958>", "phone"),
    ("john@exampⅼe.com", "email"), ("<192[.]168[.]1[.]10> at home", "ip"), ("jane_doe [at]   example    [dot] co dot uk", "email"), ("bob2 at mail.example.org", "email"),
    ("x at a dot b dot c dot d dot e dot f dot g", "email"), ("eins acht", None), ("one two three four five six seven eight nine one", None), ("room 2.0 at example.com", None), ("e.g. at example.com", None)])
def test_disguises(text, kind):
    start, end = (text.index("<"), text.index(">") - 1) if "<" in text else (0, len(text))
    text = text.replace("<", "").replace(">", "")
    assert pii.find_spans(text) == ([], [(start, end, kind)] if kind else [])


_WORDS = "zero one two three four five six seven eight nine".split()


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from(["email", "ip", "phone", "card"]))
def test_planted_disguises_map_to_their_place(seed, kind):
    rng = random.Random(seed)
    if kind == "email":
        local, host = rng.choice(["ann.lee", "bob_7", "k.o+x"]), rng.choice(["mail.example.com", "example.org"])
        hidden = rng.choice([f"{local} at {host}", f"{local}[at]{host.replace('.', '[dot]')}", f"{local} ( at ) {host.replace('.', ' dot ')}", f"{local}@{host}".replace("a", "а").replace("e", "е"),
                             f"{local}＠{host}", f"{local}@{host[:3]}\u200b{host[3:]}"])
    elif kind == "ip":
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        hidden = rng.choice([" dot ".join(parts), "[.]".join(parts), "(dot)".join(parts), " dot ".join(" ".join(_WORDS[int(c)] for c in x) for x in parts), "".join(chr(0xFF10 + int(c)) if c != "." else c for c in ".".join(parts))])
    else:
        digits = "44" + "".join(rng.choice("0123456789") for _ in range(9)) if kind == "phone" else "4" + "".join(rng.choice("0123456789") for _ in range(14))
        if kind == "card":
            digits += next(c for c in "0123456789" if pii.luhn(digits + c))
        spelled = " ".join(_WORDS[int(c)] if rng.random() < 0.9 else c for c in digits[:-4]) + " " + " ".join(_WORDS[int(c)] for c in digits[-4:])
        hidden = ("plus " if kind == "phone" else "") + spelled
    text = f"é write to: {hidden}; and go on"
    assert (12, 12 + len(hidden), kind) in pii.find_spans(text)[1]


def test_many_and_long_identifiers_in_one_text():
    assert pii.find_spans("0" * 5000 + "1.1.1.1")[0] == [(0, 5007, "ip")]
    text = " ".join(f"u{i}@example.com" for i in range(50_000)) + " x.y [at] z.org"
    plain, found = pii.find_spans(text)
    assert len(plain) == 50_000 and found == plain + [(len(text) - 14, len(text), "email")]


def test_clean_texts_have_no_hidden_spans():
    for text in ("meet me at example.com today", "un un un un un un un un un un un un", "one two three", "a dot here at noon", "x" * 200_000, " " * 100_000, "at (" * 20_000, "a at b." * 5000):
        assert pii.find_spans(text) == ([], [])


def test_redaction_and_edges(spark, edge_docs, edge_rows):
    text = "a b.c@d.ee and +1 (771) 555-1655, jo＠mail.com"
    assert pii.redact(text, pii.find_spans(text)[1]) == "a [EMAIL] and [PHONE], [EMAIL]"
    assert pii.redact("0123456789", [(1, 5, "ip"), (3, 7, "card"), (8, 9, "phone")]) == "0[IP]7[PHONE]9"
    assert pii.pii_spans(edge_docs).count() == len(edge_rows)
    out = pii.redact_documents(make(spark, [(1, text, "s"), (2, None, None), (3, "", "s")]))
    assert out.columns == edge_docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("a [EMAIL] and [PHONE], [EMAIL]", 30), 2: (None, None), 3: ("", 0)}
    assert pii.pii_spans(make(spark, [])).count() == 0


def test_viterbi_takes_the_likeliest_split():
    counts = {"free": 50, "bets": 20, "fre": 1, "ebets": 1, "casino": 9}

    def known(run):
        return {(i, n): counts[run[i: i + n]] for i in range(len(run)) for n in range(1, 21) if run[i: i + n] in counts}

    def every(run):
        return [[run]] + [[run[:i], *rest] for i in range(1, len(run)) for rest in every(run[i:])] if run else [[]]

    total = sum(counts.values())
    for run in ("freebets", "casinofree", "zzfree", "q", ""):
        def cost(parts):
            return sum(np.log(counts[p] / total) if p in counts else -np.log(total) - 2.5 * len(p) for p in parts)

        got = urls.viterbi(run, known(run), total)
        assert "".join(got) == run and abs(cost(got) - max(map(cost, every(run)))) < 1e-9
    assert urls.viterbi("freebets", known("freebets"), total) == ["free", "bets"]


def slow_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    bare = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = bare.partition("/")
    return host.translate({c: c + 32 for c in range(65, 91)}), slash + path


def slow_judge(pages):
    """(host, path) -> model verdict and score, with dictionaries."""
    split = [slow_url(u) for u, _ in pages]
    counts = Counter()
    for (host, path), (_, html) in zip(split, pages):
        text = re.sub(r"(?s)<[^>]*>", " ", html or "").lower()
        counts.update(w for part in (text, path.lower()) for w in re.findall(r"[a-z]+", part) if 1 < len(w) <= urls.LONGEST_WORD)
    counts.update(urls.SEEDS)
    total = sum(counts.values())

    def parts(run):
        return urls.viterbi(run, {(i, n): counts[run[i: i + n]] for i in range(len(run)) for n in range(1, 21) if i + n <= len(run) and run[i: i + n] in counts}, total)

    tokens = {(h, p): [w for run in re.findall("[a-z]+", h) for w in parts(run)] + re.findall("[a-z0-9]+", p.lower()) for h, p in set(split)}
    bad = {k: bool(set(t) & set(urls.SEEDS)) for k, t in tokens.items()}
    seen = {True: Counter(), False: Counter()}

    def bucket(token):
        return int(np.uint64(xxhash.xxh64_intdigest(token.encode(), 42)).astype(np.int64)) % urls.BUCKETS

    for k in split:
        seen[bad[k]].update(map(bucket, tokens[k]))
    size = len(set(seen[True]) | set(seen[False]))
    sums = {y: c.total() + size for y, c in seen.items()}
    n_bad = sum(bad[k] for k in split)
    prior = round(np.log((n_bad + 1e-9) / (len(split) - n_bad + 1e-9)) * 1e6)
    out = {}
    for k, t in tokens.items():
        if not t:
            out[k] = "allow", None
            continue
        score = prior + sum(round((np.log((seen[True][b] + 1) / sums[True]) - np.log((seen[False][b] + 1) / sums[False])) * 1e6) for b in map(bucket, t))
        out[k] = "block" if score > 0 else "allow", score
    return out


def test_urls_on_edges(spark):
    addresses = [
        "http://A.Example.NET/en/x?q#f", "https://example.net/fr/", "x.example.com/de/", "https://x.example.com/de/1", "http://org/fr/a", "http://b.org/fr", "http://é.org/fr/?a://b",
        "http://freebets.example.com/en/1", "http://www.casino-win.example.com/a", "http://news.example.com/en/2", None, "", "http://", "http://?x", "a://b\n.net/c\nd#e", "http://net/", "http://notnet/",
        "http://" + "ab" * 3000 + ".com/", "http://x.example.net", "http://x.example.org/fr/a/b"]
    rows = [(i, u, "<p>free words and news</p>" if i % 2 else None, "x", 1) for i, u in enumerate(addresses)] + [(None, addresses[0], None, "x", 1), (0, addresses[0], "", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _host string, word long")
    got = urls.judge_urls(pages).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for i, u in enumerate(addresses):
        host, path = slow_url(u)
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (by_id[i].host, by_id[i].path) == (host, path), u
        assert by_id[i].rule == (max(fits)[1] if fits else None)
        assert by_id[i].verdict == (max(fits)[2] if fits else by_id[i].verdict) and by_id[i].verdict in ("allow", "block")
    want = slow_judge([(u, h) for _, u, h, _, _ in rows])
    for r in got:
        if r.rule is None:
            assert (r.verdict, r.score) == want[r.host, r.path]
    assert by_id[8].verdict == "block" and by_id[10].verdict == "allow"
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_bounds_never_lose_a_candidate():
    rng = np.random.default_rng(3)
    v = np.r_[rng.integers(-300, 300, (400, 12)), np.zeros((30, 12), int), np.ones((30, 12), int)]
    ids = np.arange(len(v))
    pivots = pivot_distances(v, v[:8])
    norms = (v.astype(float) ** 2).sum(axis=1)
    table = np.ascontiguousarray(pivots.T)
    for q in (0, 17, 420, 455):
        got_ids, scores, seen = best_in_block(v[q], pivots[q], q, v, table, norms, ids, 5)
        exact = sorted(((-int(v[i] @ v[q]), i) for i in ids if i != q))[:5]
        assert list(zip((-scores).tolist(), got_ids.tolist())) == exact and seen <= len(v)


def test_search_on_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (None, [9.0, 9.0]), (7, [2.0]), (8, []), (100, [0.1, 0.1, 0.1])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, d long, qb long")
    got = top_inner_products(frame).collect()
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    full = matrix([v for _, v in good], 3)
    want = []
    for q in (0, 50, 100):
        vector = full[[i for i, _ in good].index(q)]
        best = sorted((-int(full[k] @ vector), i) for k, (i, _) in enumerate(good) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want
    assert top_inner_products(frame.limit(0)).count() == 0


def test_mix_on_edges(spark, edge_docs, edge_rows):
    got = mix_table(edge_docs).collect()
    assert len(got) == len(edge_rows)
    assert sum(r.size for r in got) == sum(len((t or "").encode().split()) for _, t, _ in edge_rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = mix_table(edge_docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mix_documents(edge_docs)
    assert out.columns == edge_docs.columns
    taken = Counter()
    for r in got:
        taken[r.doc_id] += r.taken
    mixed = Counter()
    for r in out.collect():
        mixed[r.doc_id] += len(r.text.encode().split())
    assert {k: v for k, v in taken.items() if v} == dict(mixed)
    assert mix_table(make(spark, [])).count() == 0 and mix_documents(make(spark, [])).count() == 0
    assert [r.taken for r in mix_table(make(spark, [(1, None, "a"), (2, " ", None)])).collect()] == [0, 0]


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice("aaaaaabc") if i % 7 else None) for i in range(1500)]
    per = {}
    for r in mix_table(make(spark, rows)).collect():
        got = per.setdefault((r.source_size, r.target), [0])
        got[0] += r.taken
    total = sum(len(t.split()) for _, t, _ in rows)
    assert abs(sum(t for _, t in per) - 1.5 * total) < 1e-6
    assert all(abs(taken - target) <= 30 and target <= 2 * size for (size, target), (taken,) in per.items())


def test_good_documents_are_likelier(spark):
    rows = [(i, "word " * 20 if i % 2 else "word& " * 20, "a" if i < 1000 else "b") for i in range(1000)] + [(2000 + i, "x " * 20, "b") for i in range(200)]
    taken = Counter()
    for r in mix_table(make(spark, rows)).collect():
        if r.doc_id < 1000 and r.taken > r.size:
            taken[r.doc_id % 2] += 1
    assert taken[1] > 2 * taken[0]


def test_toxicity_learns_and_keeps_rows(spark, edge_docs, edge_rows):
    rng = random.Random(6)
    plain_words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def text(bad):
        words = [rng.choice(plain_words) for _ in range(rng.randint(20, 80))]
        if bad:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["zwickbug", "grumhoff", "kvetchpik", "blarghund"]) + rng.choice(["", "a", "o"]))
        return " ".join(words)

    rows = [(i, text(i % 4 == 0), "s") for i in range(600)]
    docs = make(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(600)] + [(None, 1, 1), (5, None, 1), (7000, 1, 1)], "doc_id long, toxic int, text int")
    model = toxicity.train_model(docs, labels)
    got = toxicity.toxicity_table(docs, labels, model).collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.93
    kept = toxicity.drop_toxic(docs, labels, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if not r.predicted)
    edge = toxicity.toxicity_table(edge_docs, labels, model).collect()
    assert len(edge) == len(edge_rows) and all(not r.held_out for r in edge if r.doc_id is None)
    assert toxicity.toxicity_table(make(spark, []), labels, model).count() == 0
    nothing = toxicity.toxicity_table(edge_docs, labels.limit(0)).collect()
    assert len(nothing) == len(edge_rows) and all(r.predicted == 0 for r in nothing)


def test_toxicity_reads_the_text_only():
    model = toxicity.fit([b"bad zwick zwick words"] * 3 + [b"zwick a", b"zwick b", b"zwick c"], [b"good words here %d" % i for i in range(30)])
    score = toxicity.Scorer(model)
    assert score([b"", b"   "]).tolist() == [score([b""])[0]] * 2
