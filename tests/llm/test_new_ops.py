"""URL rules, spelling variants and fill-in-middle against plain readings of what they do."""

import hashlib
import random
import re
import zlib
from collections import Counter

import corpora
import pytest
from pyspark.sql import functions as F

from folio.llm import fim, spelling, url_rules
from folio.llm.words import Texts

PAGES = "page_id long, url string, html string"


def urls(seed=3, n=400):
    r = random.Random(seed)
    hosts = ["net", "a.net", "example.net", "B.Example.NET", "example.com", "x.example.com", "fr.org", "org", "knet", "example.net:80", "adult-x.example.com", "www.casino-win.example.net", "spam-farm.example.org", "bücher.de", "", "İ.net"]
    paths = ["", "/", "/en/", "/en", "/EN/1", "/de/5.html", "/fr/", "/fr/a/wp-login.php", "/cart", "/cart.html", "/x.exe", "//", "/de/?q=/en/", "?sessionid=1", "#/en/", "/a?x=1&phpsessid=2"]
    out = [f"{r.choice(['http', 'https', 'HTTP', ''])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(n)]
    return [*out, *out[:5], None, "", "no scheme net/", "a://b://net/", "://net/", "http://net/\nx", "http://a.net/en/" + "x" * 100_000]


def judged(url):
    whole = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", whole)[0]
    path = re.match(r"[^?#]*", whole[len(host) :])[0]
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    host = low(host)
    fit = [(len(t), t, v) for v, t in url_rules.HOST_RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    labels = ["." + host, *["." + host[i + 1 :] for i, c in enumerate(host) if c == "."]]
    sep = "[^a-z0-9_.%-]"
    rest = low(host + whole[len(host) :])
    starts = lambda p: any(re.match(p, x[1:] + rest[len(host) :], re.S) for x in labels)
    block = any(starts(p) for p in (r"adult-.*\.", r"ads-track\.", r"casino-.*\.", r"cheap-pills\.", r"free-bets\.", r"spam-farm\."))
    block |= any(re.search(p, rest, re.S) for p in (r"/wp-login\.php", rf"/(cart|signin)({sep}|\Z)", rf"{sep}(sessionid|phpsessid)=", r"\.exe\Z"))
    return host, path, None, "block" if block and not starts(rf"spam-farm\.example\.org{sep}fr({sep}|\Z)") else "allow"


def test_op11(spark):
    rows = [(i, u, "h") for i, u in enumerate(urls())] + [(None, "http://net/", None), (3, "http://net/", None)]
    pages = spark.createDataFrame(rows, PAGES)
    got = Counter(tuple(r) for r in url_rules.digest(pages.select("*", F.lit(1).alias("rule"), F.lit(2).alias("token"), F.lit(3).alias("_row"))).collect())
    assert got == Counter((i, *judged(u)) for i, u, _ in rows)
    wide = pages.select("*", F.lit("mine").alias("verdict"), F.lit("own").alias("host"))
    kept = url_rules.apply(wide, url_rules.rule_table(spark))
    assert kept.columns == wide.columns and {(r.verdict, r.host) for r in kept.collect()} == {("mine", "own")}
    assert Counter(r.page_id for r in kept.collect()) == Counter(i for i, u, _ in rows if judged(u)[3] == "allow")
    empty = pages.limit(0)
    assert url_rules.digest(empty).count() == 0
    assert {r.verdict for r in url_rules.digest(pages, url_rules.rule_table(spark, [], [])).collect()} == {"allow"}


def test_op11_index(spark):
    """Rarest tokens; rules without a token of their own; no candidate but by its token."""
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.site.example/common/{'rare' if i == 7 else 'x'}/{i}", "") for i in range(30)], PAGES)
    rules = url_rules.rule_table(spark, [("block", None), ("block", ""), ("block", "/en/")], ["/common/rare/", "x/2", "||h1.*common", "|", "*", "mmo", ".example/*/29|"])
    held = {r.text: r.token for r in url_rules.index(rules, pages).collect()}
    assert held == {"/common/rare/": "rare", "x/2": "", "||h1.*common": "h1", "mmo": "", ".example/*/29|": "29"}
    assert {r.page_id for r in url_rules.digest(pages, rules).filter("verdict = 'block'").collect()} == set(range(30))  # `mmo`
    few = url_rules.rule_table(spark, [], ["/common/rare/", ".example/*/29|", "x/2"])
    assert {r.page_id for r in url_rules.digest(pages, few).filter("verdict = 'block'").collect()} == {2, 7, *range(20, 30)}


def spelled(rows, slip):
    """A plain reading: word -> (form, root, n, n_near, form_n)."""
    count = Counter()
    for doc_id, text, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[a-z\u00c0-\u00ff]+", low):
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    own = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in own if edits(w, x) == 1] for w in own}
    form = {}
    for w, held in near.items():
        best = min(held, key=lambda x: (-own[x], x), default=None)
        form[w] = best if best and own[best] >= 2 * own[w] else None
    out = {}
    for w in own:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, own[w], len(near[w]), own.get(form[w]))
    return out


def edits(a, b):
    """Levenshtein distance, or 2 if it is above 1."""
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row[-1], 2)


def letters(seed, docs=40):
    r = random.Random(seed)
    parts = ["tion", "ther", "ßa", "éÉ", "aa", "ab", "zz", "q", "xyx", "Ment"]
    words = ["".join(r.choice(parts) for _ in range(r.randint(2, 4))) for _ in range(60)]
    for w in list(words):
        i = r.randrange(len(w))
        words += [w[:i] + w[i + 1 :], w[:i] + r.choice("abé") + w[i:], w[:i] + r.choice("abé") + w[i + 1 :]]
    return [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(len(words))], k=120)) + "\n12, ok", None, None, 0) for i in range(docs)]


@pytest.mark.parametrize("options", [{}, {"crowd": 0}, {"crowd": 2}, {"shard": 4, "texts": 3}])
def test_op12(spark, options):
    rows = [*letters(5), *letters(5)[:3], (None, "tionther tionther Tionther \U0001f600tionthér", "a", None, 0), (77, None, None, None, 0), (78, "", None, None, 0)]
    docs = corpora.frame(spark, rows).select("*", F.lit("x").alias("word"), F.lit("y").alias("n"), F.lit("z").alias("seg"))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.digest(docs, slip=7, **options).collect()}
    want = spelled(rows, 7)
    assert got == want and any(v[1] != k and v[1] != v[0] for k, v in want.items()), "chains of two forms are in it"
    assert any(v[3] == 0 for v in want.values())


def test_op12_empty_and_giant(spark):
    assert spelling.digest(corpora.frame(spark, [])).count() == 0
    assert spelling.digest(corpora.frame(spark, [(1, "once only words", None, None, 0), (2, None, None, None, 0)])).count() == 0
    giant = "a" * 200_000
    rows = [(None, f"{giant} {giant}b {giant} {giant} {giant}b {giant}b", None, None, 0)] * 2 + [(None, "some words here and there " * 200_000, None, None, 0)]
    got = {r.word: r for r in spelling.digest(corpora.frame(spark, rows)).collect()}
    assert got[giant].n == 6 and got[giant].n_near == 1 and got[giant + "b"].form is None and got["words"].n == 200_000


def filled(doc_id, text):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(units)
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) else "spm" if h[3] % 100 < 50 else "psm"
    out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(out), sha(t))


def lined(seed=9):
    r = random.Random(seed)
    texts = ["".join(r.choice(["\n", "a", "é", "😀 b", "\r", " " * 300, "x" * 255]) for _ in range(r.randint(0, 60))) for _ in range(60)]
    texts += ["\n", "\n\n\n", "a", "a\n", "\na", "<P>\n", "x<S>", "<M", "<\n>P>\n<S", "x" * 256, "x" * 256 + "\n", "x" * 255 + "\n", "\n" * 1000]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)] + [(None, "no\nid\n", None, None, 0)] * 2 + [(None, None, None, None, 0), (5, None, None, None, 0), (6, "", None, None, 0)]
    return rows + [rows[3], rows[3], (3, "another\ntext", None, None, 0)]


@pytest.mark.parametrize("giant", [fim.GIANT, 700, 16])
def test_op13(spark, giant):
    """Where texts are scanned in one piece, and where those above `giant` bytes are dealt out in chunks."""
    rows = lined() + corpora.sample(4, 20)
    docs = corpora.frame(spark, rows).select("*", F.lit("x").alias("cuts"), F.lit("y").alias("form"), F.lit("z").alias("_row"))
    got = Counter(tuple(r) for r in fim.digest(docs, giant=giant).collect())
    assert got == Counter(filled(r[0], r[1]) for r in rows)
    out = fim.apply(docs, giant=giant)
    assert out.columns == docs.columns and {(r.cuts, r.form) for r in out.collect()} == {("x", "y")}
    assert sum(r.text is None for r in out.collect()) == sum(r[1] is None for r in rows)
    assert fim.digest(docs.limit(0), giant=giant).count() == 0


@pytest.mark.parametrize("giant", [fim.GIANT, 40])
def test_op13_other_units(spark, giant):
    """Sentences as units: an automaton of three states, chunks entered in any of them."""
    r = random.Random(2)
    rows = [(i, "".join(r.choice(["a", "é", ". ", "! ", "?", " ", ".\n", "..", "ab"]) for _ in range(r.randint(0, 120))), None, None, 0) for i in range(40)]
    got = {x["_row"]["c0"]: x for x in fim.transform(corpora.frame(spark, rows), automaton=fim.SENTENCES, giant=giant).collect()}
    for i, text, *_ in rows:
        units = re.findall(r"(?s).*?[.!?]+(?:[ \n\t\r\x0b\x0c]|\Z)|.+\Z", text)
        parts = re.findall(r"(?s).*?(?<=[.!?])[ \n\t\r\x0b\x0c]|.+\Z", text)
        assert "".join(parts) == text and got[i].n == len(parts), (units, parts)
        if got[i].form != "plain":
            assert any(len("".join(parts[:k])) == got[i].prefix_chars for k in range(len(parts) + 1))


def test_op13_scan():
    """Composition: a text's function equals that of its chunks, for every entry state and cut."""
    text = ("one. two! three? four\n" * 40).encode()
    automaton = fim.SENTENCES
    _, follow, ends = automaton.tables()
    whole = fim.Scan(Texts(fim.pa.array([text.decode()])).data, fim.np.array([0, len(text)]), automaton)
    state, n = whole.whole()
    for entry in range(3):
        s, k, places = entry, 0, []
        for at, b in enumerate(text, 1):
            c = automaton.classes[b]
            k, s = k + ends[s, c], follow[s, c]
            if ends[:, c].any() and k > len(places):
                places.append(at)
        assert (state[0, entry], n[0, entry]) == (s, k)
        ask = fim.np.arange(1, int(k) + 1)
        assert [int(whole.find(fim.np.array([0]), fim.np.array([i]), fim.np.array([entry]))[0]) for i in ask] == places
