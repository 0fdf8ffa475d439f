"""Each operator against brute force on small rows: nulls, empty tables, ties, repeated rows, extra columns with clashing names."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import chat, decontaminate, htmltext, langid, mixing, multiset, neardup, passages, pii, registry, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, term string"


def frame(spark, rows):
    full = [(i, t, lang, src, len(t or ""), "clash", "clash") for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


def texts(spark, pairs):
    return frame(spark, [(i, t, "en", "s") for i, t in pairs])


def words(n, seed, vocabulary=40):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


BIG = 2**60 + 1


def test_ids_keep_their_bits_beside_nulls(spark):
    """Ids beyond what a double holds, in one batch with a null id."""
    docs = texts(spark, [(BIG, "one two three four five"), (None, "six seven eight"), (BIG + 2, None)]).coalesce(1)
    path = registry.tokenizer_path()
    for made in (tokens.encode_corpus(docs, path, shards=1), neardup.near_duplicates(docs, n=4), langid.identify(docs), passages.remove(docs)):
        assert {r.doc_id for r in made.collect()} == {BIG, None, BIG + 2}
    pages = spark.createDataFrame([(BIG, "u", "<p>x"), (None, "v", "<p>y")], "page_id long, url string, html string").coalesce(1)
    assert {r.page_id for r in htmltext.extract(pages).collect()} == {BIG, None}


# 1


def brute_decontaminate(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = []
    for i, t in items:
        w = cut(t)
        windows += [(str(i), tuple(w[j : j + 13])) for j in range(max(1, len(w) - 12))] if w else []
    out = []
    for i, t in docs:
        w, hit, ids = cut(t), set(), set()
        for item, win in windows:
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    ids.add(item)
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination(spark):
    item = " ".join(words(20, 1))
    docs = [(1, "x y " + item.upper() + " z"), (2, " ".join(words(13, 1))), (3, None), (4, ""), (5, "the Ünï cat"), (5, "the Ünï cat"), (None, item), (6, "ünï"), (7, " ".join(words(500, 3, 3))), (8, "...!"), (9, item + " and more " * 300)]
    items = [(10, item), (2, item), (3, "Ünï cat"), (4, None), (5, ""), (6, " ".join(words(13, 3, 3)))]
    got = decontaminate.digest(decontaminate.decontaminate(texts(spark, docs), spark.createDataFrame(items, "item_id long, text string"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == brute_decontaminate(docs, items)


def test_decontamination_of_nothing(spark):
    none = texts(spark, [])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.decontaminate(none, items).count() == 0
    some = decontaminate.digest(decontaminate.decontaminate(texts(spark, [(1, "a b")]), items.limit(0))).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in some] == [(2, 0, False)]


def test_proximity(spark):
    docs = texts(spark, [(1, "alpha x x beta"), (2, "beta " + "x " * 30 + "alpha"), (3, "alpha")])
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    got = decontaminate.proximity_matches(docs, items, 5).collect()
    assert [(r.item_id, r.distance, r.key.split(":")[0]) for r in got] == [("1", 3, "1")]


# 2


def luhn(s):
    return sum((int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2)) for i, c in enumerate(reversed(s))) % 10 == 0


def brute_pii(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii(spark):
    r = random.Random(5)
    docs = [(1, None), (2, ""), (3, "a@b.c_d@e.f x.y@z"), (4, "é😀 1.2.3.4.5.6.7.8 0001.2.3.255 256.1.1.1"), (5, "4242 4242-4242 4242, 4242424242424242 4242424242424241"), (6, "+1 (243) 555-5526+1+49 30 1234567"), (7, "a" * 100_000 + "@"), (8, "9" * 50_000), (8, "9" * 50_000), (None, "x@y.zz")]
    docs += [(100 + i, "".join(r.choice("ab1.@+-_ 4é😀(2") for _ in range(400))) for i in range(60)]
    got = pii.personal_data(texts(spark, docs)).collect()
    want = []
    for i, t in docs:
        s = brute_pii(t)
        n = [sum(x[0] == k for x in s) for k in pii.BASE]
        want.append((i, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
    assert sorted((tuple(x[:6]) for x in got), key=str) == sorted(want, key=str)


def test_pii_more(spark):
    docs = [(1, "pay to IBAN DE89 3704 0044 0532 0130 00 now"), (2, "IBAN DE88370400440532013000"), (3, "ssn 123-45-6789"), (4, "order 123-45-6789"), (5, "my amex card 378282246310005")]
    got = {r.doc_id: r.spans for r in pii.personal_data(texts(spark, docs)).collect()}
    assert got == {1: "iban:12:39", 2: "", 3: "ssn:4:15", 4: "", 5: "amex:13:28"}
    assert pii.personal_data(texts(spark, [])).count() == 0


# 3


def brute_targets(sizes, total=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = total * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def brute_sainte_lague(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min(votes, key=lambda p: (-votes[p] / (2 * won[p] + 1), p))
        won[best] += 1
    return won


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, " ".join(words(r.randrange(0, 300), i)), "en", r.choice(["a", "b", "b", "b", "é", None, "z"])) for i in range(300)]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "none"), (1002, "w " * 40_000, "en", "long"), (1003, "q w", "en", "a"), (1003, "q w", "en", "a"), (None, "x y z", "en", "b")]
    docs = frame(spark, rows)
    got = mixing.mix(docs, block=4, shard_words=2000).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = brute_targets(size)
    for s in size:
        own = [x for x in got if x.source == s]
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == size[s]
        assert abs(sum(x.taken for x in own) - want[s]) <= max(24, 0.01 * want[s])
    assert all(0 <= x.taken <= 2 * x.size for x in got)
    again = mixing.mix(docs.repartition(7), block=4, shard_words=2000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    made = mixing.mixed(docs, block=4, shard_words=2000)
    assert made.columns == docs.columns
    assert sum(len(x.text.split()) for x in made.collect()) == sum(x.taken for x in got)


def test_apportionment(spark):
    r = random.Random(4)
    for n, seats in ((1, 5), (3, 10), (12, 7), (40, 333)):
        votes = {f"p{i:02}": r.choice([1, 10, 1000]) * r.random() for i in range(n)}
        df = spark.createDataFrame([(p, v, seats) for p, v in votes.items()], "p string, v double, s long")
        got = {x.p: x.n for x in mixing.apportion(df, "v", "s", "n", [], ["p"]).collect()}
        assert got == brute_sainte_lague(votes, seats)


def test_mixing_of_nothing(spark):
    assert mixing.mix(texts(spark, [])).count() == 0
    assert [x.target for x in mixing.mix(texts(spark, [(1, None)])).collect()] == [0.0]


# 4


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    tok = Tokenizer.from_file(path)
    docs = [(5, "Hello, world! it's 42"), (-3, None), (7, ""), (9, "a<|endoftext|>b ÀÉ ß × « » Σας İ é"), (9, "x\x1cy"), (None, "nobody"), (11, "word " * 30_000), (12, " \t\n")]
    folder = f"file://{tmp_path}/set"
    got = tokens.encode_corpus(texts(spark, docs), path, folder, shards=3).collect()
    got = sorted(got, key=lambda r: r.start)
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    at = 0
    assert [r.doc_id for r in got] == [d[0] for d in order]
    for r in got:
        choices = [tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in docs if i == r.doc_id]
        assert (r.start, r.n_tokens) == (at, r.n_tokens)
        assert (r.n_tokens, r.ids_crc32) in [(len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for c in choices]
        at += r.n_tokens
    assert not list((tmp_path / "set").glob("*.part"))
    assert tokens.encode_corpus(texts(spark, []), path, f"file://{tmp_path}/none", shards=2).count() == 0
    wide = tokens.encode_corpus(texts(spark, docs), path, f"file://{tmp_path}/wide", shards=2, width=32).collect()
    assert sorted(map(str, wide)) == sorted(map(str, got))


# 5


def brute_components(docs, n=4, similar=80):
    def shingled(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = {i: shingled(t) for i, t in docs}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= similar * len(sets[a] | sets[b]):
            up[max(top(a), top(b))] = min(top(a), top(b))
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets.items())


def near_copies(seed):
    r = random.Random(seed)
    docs = []
    for g in range(12):
        base = words(120, g, 5000)
        for _ in range(r.randrange(1, 9)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5, 9])):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            docs.append(" ".join(w))
            base = w if r.random() < 0.4 else base
    r.shuffle(docs)
    return [(i + 10, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    docs = [*near_copies(seed), (1, None), (2, ""), (3, "One two"), (4, "one TWO"), (5, "É two"), (6, "é two"), (7, " ")]
    got = sorted(map(tuple, neardup.near_duplicates(texts(spark, docs), n=4).collect()))
    assert got == brute_components(docs)


def test_near_duplicates_of_odd_rows(spark):
    docs = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, "a b c d e")]
    got = sorted(map(tuple, neardup.near_duplicates(texts(spark, docs), n=4).collect()), key=str)
    assert got == [(3, 2, 3, True), (3, 2, 3, True), (9, 2, 3, False), (None, 2, None, True)]
    assert neardup.near_duplicates(texts(spark, [])).count() == 0


def test_chain_of_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in neardup.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# 6


def test_language_id(spark):
    r = random.Random(3)
    make = lambda parts: " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(40))
    kinds = {"xx": ["tion", "the", "ing", "sh"], "yy": ["eau", "é", "oi", "que"], "zz": ["ich", "ü", "sch", "ung"]}
    rows = [(i, make(kinds[k]), k, k) for i, k in enumerate([*kinds] * 60)]
    rows += [(1000, None, "xx", "s"), (1001, "12 !!", "xx", "s"), (1002, make(kinds["yy"]), None, None), (None, make(kinds["zz"]), "zz", "s"), (1003, "", None, "s"), (1004, "é" * 5000, None, "s")]
    got = langid.identify(frame(spark, rows)).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got if x.doc_id is not None)
    held = [(by[i].lang_pred, k) for i, _, k, _ in rows[:180] if by[i].held_out]
    assert held and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [by[i].lang_pred for i in (1000, 1001, 1003, 1002)] == ["und", "und", "und", "yy"] and by[None].lang_pred == "zz"
    unlabelled = langid.identify(frame(spark, [(1, "abc", None, "s")])).collect()
    assert [(x.lang_pred, x.score) for x in unlabelled] == [("und", 0.0)]
    assert langid.identify(frame(spark, [])).count() == 0


def test_network_gradients():
    net = langid.Network(["a", "b"], hidden=3, seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = np.ascontiguousarray(np.frombuffer(b"abcdbca\0", np.uint8).reshape(2, 4).T), np.array([0, 1])
    _, g = net.gradients(x, y)
    for k, i in (("hzf", (1, 2)), ("hrf", (0, 1)), ("hcb", (0, 1)), ("xzf", (98, 1)), ("xrb", (99, 0)), ("xcb", (99, 2)), ("o", (2, 1)), ("ob", (1,))):
        was = net.w[k][i]
        net.w[k][i] = was + 1e-4
        up = net.gradients(x, y)[0]
        net.w[k][i] = was - 1e-4
        down = net.gradients(x, y)[0]
        net.w[k][i] = was
        assert g[k][i] == pytest.approx((up - down) / 2e-4, abs=1e-5)


def test_positions_against_a_slow_network():
    """Each position's distribution by the equations, one byte at a time, with the state carried over white space."""
    net = langid.Network(["a", "b", "c"], hidden=4, seed=3)
    w = {k: v.astype(np.float64) for k, v in net.w.items()}

    def states(span, d):
        h, out = np.zeros(4), []
        for c in span if d == "f" else reversed(span):
            squash = lambda a: a / (1 + abs(a))
            z, r = (0.5 + 0.5 * squash(w[f"x{g}{d}"][c] + h @ w[f"h{g}{d}"]) for g in "zr")
            h = (1 - z) * h + z * squash(w[f"xc{d}"][c] + (r * h) @ w[f"hc{d}"])
            out.append(h)
        return out if d == "f" else out[::-1]

    r = random.Random(6)
    made = ["x", "ab cd", "é  zz", "".join(r.choice("abcdé ") for _ in range(700))]
    got = net.documents([langid.read_as(t) for t in made])
    for t, p in zip(made, got, strict=True):
        t, total = langid.read_as(t), np.zeros(3)
        for i in range(0, len(t), langid.SPAN):
            lo = max(0, i - langid.CONTEXT)
            span = t[lo : i + langid.SPAN + langid.CONTEXT]
            f, b = states(span, "f"), states(span, "b")
            for j in range(i, min(len(t), i + langid.SPAN)):
                e = np.exp(np.concatenate([f[j - lo], b[j - lo]]) @ w["o"] + w["ob"])
                total += e / e.sum()
        assert p == pytest.approx(total / len(t), abs=1e-4)


# 7


def test_fingerprints(spark):
    docs = [(4, "alpha beta, gamma.\nsecond line here\n" * 5), (2, "one two three four. five six seven eight. nine ten eleven twelve"), (9, None), (7, ""), (8, "é😀xy"), (8, "é😀xy"), (None, "no id"), (11, "z" * 5000)]
    got = multiset.compared(texts(spark, docs)).collect()
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, hashlib.md5((d[1] or "").encode()).hexdigest()))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
    assert sorted(((x.doc_id, x.n_chars, x.edited_sha256) for x in got), key=str) == sorted(want, key=str)
    prints = {}
    for x in got:
        prints.setdefault((x.n_chars, x.doc_id), set()).add(x.fingerprint)
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 and len(x.fingerprint) == 8 * 73
    assert all(len(v) == 1 for v in prints.values())
    assert multiset.compared(texts(spark, [])).count() == 0


def test_multiset_laws(spark):
    rows = spark.createDataFrame([("ab c\nde f",), ("de f\nab c",), ("ab c",), ("de f",)], "t string")
    got = [r.l for r in multiset.with_fingerprint(rows, "t", "l").collect()]
    assert got[0] == got[1] and got[0] != got[2]
    both = spark.createDataFrame([(got[2], got[3], got[0])], "a array<long>, b array<long>, c array<long>")
    out = both.select(multiset.combine("a", "b").alias("sum"), multiset.combine("c", "b", -1).alias("less")).first()
    assert out["sum"] == got[0] and out["less"] == got[2]


# 8

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href="/">Home</a></nav>
<div class="ad">Buy</div><div class="cookie-notice">We use cookies</div><article><h1>Head &amp; more</h1><p><b>First   para<br>with break<p>Short.
<form><input><button>Go</button></form><aside>Side</aside><p>Third&nbsp;one <a href="x">link</a>s.</article>
<section id="comments"><p>A reader says something long enough to look like text of the article itself.</p></section><footer>&copy; x</footer>"""


def test_main_text(spark):
    want = "Head & more First para with break Short. Third one links."
    assert htmltext.main_text(PAGE) == want
    plain = "<div><a href='1'>a</a> <a href='2'>b</a> <a href='3'>c</a></div><div>" + "".join(f"<p>{'long text of the page ' * 8}{i}</p>" for i in range(6)) + "</div><div><a href='4'>d</a> | <a>e</a></div>"
    assert htmltext.main_text(plain) == " ".join("long text of the page " * 8 + str(i) for i in range(6))
    rows = [(1, "u", PAGE, "c"), (2, None, None, "c"), (None, "v", "", "c"), (1, "u", PAGE, "c"), (3, "w", "<<<>&&<p", "c"), (4, "x", "<p>" * 5000 + "deep", "c")]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got[:4]] == [(1, want, len(want)), (2, "", 0), (None, "", 0), (1, want, len(want))]
    assert got[5].text == "deep"


# 9


def brute_chat(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    said = {c: [(p[2:]) for p in sorted(v)] for c, v in convs.items()}
    out = []
    for c, v in said.items():
        if any(len(w) > len(v) and w[: len(v)] == v for w in said.values()):
            continue
        same = [d for d, w in said.items() if w == v]
        if c == min(same, key=lambda d: (d is None, d or 0)):
            out.append((c, len(v), len(same), "".join(f"<|{r}|>\n{x}\n<|end|>\n" for _, r, _, x in v)))
    return sorted(out, key=str)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", None), (5, 0, "user", ""), (6, 0, None, "x"), (6, 0, None, "x"), (None, 3, "user", "z"), (7, None, "user", "n"), (7, 2000, "user", "far"), (7, 5, "user", "mid")]
    rows += [(50, i, "user", f"t{i}") for i in range(2500)] + [(51, i, "user", f"t{i}") for i in range(1700)]
    got = chat.collapse(spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, place string")).collect()
    assert sorted(((r.conv_id, r.n_turns, r.n_equal, r.text) for r in got), key=str) == brute_chat(rows)
    assert chat.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 10


def brute_passages(docs, n):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = {}
    for w in split:
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])] = seen.get(tuple(w[i : i + n]), 0) + 1
    out = []
    for (i, _), w in zip(docs, split, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if seen[tuple(w[j : j + n])] > 1:
                gone[j : j + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_passages(spark):
    shared, r = words(60, 99, 10**6), random.Random(8)
    docs = [(1, None), (2, ""), (3, "a b"), (4, " ".join(words(9, 4))), (4, " ".join(words(9, 4))), (None, "é " * 40), (5, "x y " * 50)]
    for i in range(40):
        w = words(r.randrange(1, 200), i, 10**6)
        a = r.randrange(0, 50)
        w[r.randrange(len(w)) : 0] = shared[a : a + r.randrange(0, 60)] if r.random() < 0.6 else []
        docs.append((100 + i, "\t".join(w)))
    for window in (35, 11):
        got = passages.remove(texts(spark, docs), window=window, chunk_words=300, shard=7)
        assert sorted(map(tuple, got.collect()), key=str) == brute_passages(docs, window)
    assert passages.remove(texts(spark, [])).count() == 0


def test_passage_batches_do_not_grow_with_a_split(spark, monkeypatch):
    docs = [(i, " ".join(words(60, i % 30)) + ("\n" if i % 2 else " \t") + "é" * (i % 5)) for i in range(200)]
    one = texts(spark, docs).coalesce(1)
    sizes = [r.n for r in passages.batches_of(one, most=2_000).groupBy("batch").agg(F.sum(F.octet_length("text")).alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) < 4_000
    make = passages.batches_of
    monkeypatch.setattr(passages, "batches_of", lambda d: make(d, 100))  # more batches than there are numbers for
    assert sorted(map(tuple, passages.remove(one).collect()), key=str) == brute_passages(docs, 35)


def test_rolling_hashes_tell_windows_apart():
    h = np.array([passages.mixed(np.array([x], np.uint64))[0] for x in (1, 2, 3, 1, 2, 3, 2, 1, 3)], np.uint64)
    for k in range(1, 9):
        got = passages.rolling(h, k, passages.A)
        same = {(i, j) for i in range(len(got)) for j in range(len(got)) if got[i] == got[j]}
        assert same == {(i, j) for i in range(len(got)) for j in range(len(got)) if (h[i : i + k] == h[j : j + k]).all()}
        assert (passages.least(h, k) == [h[i : i + k].min() for i in range(len(h) - k + 1)]).all()
