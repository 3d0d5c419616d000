"""Spelling variants, chat formatting and centroids against brute force, and on odd inputs."""

import hashlib
import inspect
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import centroids, chat, line_dedup, secrets, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- spelling variants
def brute_variants(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    form, out = {}, {}
    for w in words:
        near = [v for v in words if v != w and abs(len(v) - len(w)) <= 1 and edits(v, w) == 1]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
        out[w] = len(near)
    root = lambda w: root(form[w]) if form[w] else w
    return sorted((w, form[w], root(w), words[w], out[w], words[form[w]] if form[w] else None) for w in words)


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def ours(found):
    return sorted(map(tuple, found.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


@pytest.fixture(scope="module")
def typos():
    r = random.Random(4)
    base = ["".join(r.choice("abé") for _ in range(r.randint(6, 10))) for _ in range(60)] + ["internationalisation" * 3, "ÉCLAIRÉE", "aaaaaaaa"]
    out = []
    for doc in range(150):
        words = []
        for _ in range(60):
            w = base[min(int(r.expovariate(0.08)), len(base) - 1)]
            if r.random() < 0.15:
                i = r.randrange(len(w))
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "a" + w[i + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        out.append((doc, r.choice([" ", "1", "\n", "×y "[1:], "Ā"]).join(words)))
    return [*out, out[0], (None, out[1][1]), (None, None), (151, ""), (152, "x" * 100_000 + " 😀 " + "x" * 100_000), (155, "Chainable " * 400 + "chainible " * 30 + "chainiblee " * 3)]


@pytest.mark.parametrize(("shard", "scanned"), [(20_000, 100_000), (7, 11)])
def test_variants_equal_brute_force(spark, typos, monkeypatch, shard, scanned):
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "SCANNED", scanned)
    docs = spark.createDataFrame([(d, t, "w", 1) for d, t in typos], "doc_id long, text string, word string, n int")
    want = brute_variants(typos)
    assert ours(spelling.variants(docs)) == want
    assert sum(1 for r in want if r[2] not in (r[0], r[1])) > 0  # chains of forms are followed


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=6), st.text("abc", min_size=1, max_size=6))
def test_one_edit(a, b):
    assert spelling.one_edit(a, b) == (edits(a, b) == 1)


# ---------------------------------------------------------------- chat formatting
def digests(turns):
    all_turns = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    said = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), all_turns, len(said), hashlib.sha256(said.encode()).hexdigest()


TRICKY = ["", None, "\\", "\\\\", "</turn>", "\\</turn>\n", "### ", "####  ", "</tur", "<</turn></turn>", "a:\n### b:\n</turn>\n", "é😀\u2028", "\\### Assistant: </turn> ok", "x" * 5000]


@pytest.mark.parametrize("limit", [chat.PART, 10])
def test_conversations_are_read_back(spark, limit):
    r = random.Random(1)
    talks = {k: [(r.choice(["user", "assistant", "system", None, "a:\n", "\\", "### x"]), r.choice(TRICKY)) for _ in range(r.randint(1, 9))] for k in range(40)}
    rows = [(k, i, *t, "extra") for k, ts in talks.items() for i, t in enumerate(ts)] + [(None, None, "user", "null id", "extra"), (None, None, "user", "null id", "extra")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string").repartition(3)
    formatted = chat.format_conversations(df, limit=limit).cache()
    got = {x.conv_id: tuple(x)[1:] for x in chat.read_back(formatted).collect()}
    want = {k: digests(ts) for k, ts in talks.items()} | {None: digests([("user", "null id")] * 2)}
    assert {k: v[:4] for k, v in got.items()} == want
    chars = {x.conv_id: x.n for x in formatted.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert {k: v[4] for k, v in got.items()} == chars
    assert (formatted.count() == 41) == (limit > 10)


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.round_trip(df).collect() == []


def render(template, messages):
    return "".join(f"[{t}]" if m else t for t, m in chat.compiled(template)(messages))


MESSAGES = [{"role": "system", "text": " be brief "}, {"role": "user", "text": "hi"}, {"role": "assistant", "text": "Hello"}]


@pytest.mark.parametrize(
    ("template", "want"),
    [
        ("{% for m in messages %}{{ loop.index }}/{{ m['role'] | upper }}{% if not loop.last %}, {% endif %}{% endfor %}", "1/SYSTEM, 2/USER, 3/ASSISTANT"),
        ("{% set bos = '<s>' %}{{ bos }}{% for m in messages %}{% if m.role == 'system' %}({{ m.text | trim }}){% elif m.role == 'user' %}U{% else %}{% generation %}{{ m.text }}</s>{% endgeneration %}{% endif %}{% endfor %}", "<s>(be brief)U[Hello][</s>]"),
        ("a {%- if true and not false -%} b {%- else %} c {% endif %} d{# no #}", "ab d"),
        ("{{ 1 + 2 ~ 'x' }}{{ missing.field | default('none') }}{{ 'a' in 'cat' }}{{ 2 >= 3 or 'y' }}{{ none }}", "3xnonetruey"),
        ("{% for m in messages %}{{ loop.first and m.text | length }}{% endfor %}", "10falsefalse"),
        ("{{ messages.__class__ }}{{ '\\n\\'' }}{{ 'a' < 1 }}", "\n'false"),
    ],
)
def test_templates(template, want):
    assert render(template, MESSAGES) == want


@pytest.mark.parametrize("bad", ["{{ f(1) }}", "{{ 'a' | eval }}", "{% for m in messages %}", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{% import os %}", "{{ a", "{{ }}", "{% if a %}{% endfor %}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ " + "(" * 99 + "1" + ")" * 99 + " }}", "x" * 200_000])
def test_refused_templates(bad):
    with pytest.raises(chat.TemplateError):
        chat.compiled(bad)


def test_constants_are_folded():
    tree = chat.fold_block(chat.parse("a{{ 'b' | upper }}{% if 1 == 2 %}no{{ x }}{% else %}c{{ 1 + 1 }}{% endif %}{{ x and true }}{{ false and x }}"))
    assert tree == [("text", "aBc2"), ("out", ("op", "and", ("name", "x"), ("const", True))), ("text", "false")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab:\n\\# ", max_size=6), st.text("\\</turn>#\n: é", max_size=20)), max_size=5), st.integers(1, 40))
def test_turns_round_trip(talk, limit):
    pieces = chat.compiled(chat.TEMPLATE)({"role": r, "text": t} for r, t in talk)
    assert list(chat.turns(p[2] for p in chat.parts(pieces, limit))) == talk


@pytest.mark.parametrize("controls", [("aa",), ("ab", "bc"), ("",), ("a\\",), ("xay", "a")])
def test_controls_that_cannot_be_escaped(controls):
    with pytest.raises(chat.TemplateError):
        chat.check_controls(controls)


# ---------------------------------------------------------------- centroids
def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else m for j, m in enumerate(c)]
    found = [(i, *near(q)[::-1]) for i, q in kept]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in found), key=str)


@pytest.mark.parametrize(("n", "common"), [(200, 1000), (200, 3), (7, 1000)])
def test_clusters_equal_brute_force(spark, monkeypatch, n, common):
    monkeypatch.setattr(centroids, "COMMON", common)
    r = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in r.normal(i % 5, 0.3, 64)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(n // 2)] + [(0, rows[0][1]), (None, rows[1][1]), (5, rows[2][1]), (2000, [0.5] * 64), (2001, [-0.001] * 64)]
    odd = [(1, None), (2, [1.0] * 63), (3, [1.0] * 65), (4, [None] + [1.0] * 63), (5, [float("nan")] + [1.0] * 63), (6, [float("inf")] + [1.0] * 63), (7, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<float>, q string, cluster int").repartition(4)
    assert sorted(map(tuple, centroids.cluster(df).collect()), key=str) == brute_clusters(rows)


def test_no_vectors_and_huge_ones(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([(1, [1.0])], schema)).collect() == []
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]
    found = centroids.cluster(spark.createDataFrame(rows, schema), k=1).collect()
    assert {r.vec_id for r in found} == {1, 2, 3} and all(r.distance >= 0 for r in found)


def test_sums_beyond_64_bits():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([[2**27 - 1, -3]] * 3, pa.list_(pa.int32())), pa.array([2**40, 2**41, 1], pa.int64())], names=["q", "weight"])
    (out,) = centroids._summing(np.array([[0, 0]]))(iter([batch]))
    n = 2**40 + 2**41 + 1
    assert [int(x) for x in out.column(2).to_pylist()] == [(2**27 - 1) * n, -3 * n, n]


# ---------------------------------------------------------------- secrets: labelled tokens
WORDS = "customer order payment invoice session handler report backup daily weekly server client request image thumb upload region storage bucket column index primary metrics service account profile release build deploy cache worker thread message stream cluster replica snapshot".split()


def random_token(r):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "0123456789"
    kinds = (letters + letters.lower(), letters, letters + letters.lower() + "-_")
    return "".join(r.choice(r.choice(kinds)) for _ in range(r.randint(20, 44)))


def ordinary_token(r):
    a, b, c = (r.choice(WORDS) for _ in range(3))
    y, m, d, n = r.randint(2000, 2030), r.randint(1, 12), r.randint(1, 28), r.randint(0, 99_999)
    return r.choice([f"{y}-{m:02}-{d:02}_{a}_{b}_full", f"{a}_{b}_{c}_{n}", f"{a}-{b}-{y}{m:02}{d:02}-{c}", f"{a}{b.title()}{c.title()}V{m}", f"{a}_v{m}_{d}_{b}_{c}", f"src/{a}/{b}/{c}_{n}", f"{a.upper()}_{b.upper()}_{c.upper()}_{n}"])


def test_secrets_among_labelled_tokens(spark):
    """500 random strings and 500 identifiers with digits, each in a text of its own."""
    r = random.Random(11)
    usable = lambda t: len(t) >= 20 and re.search("[0-9]", t) and re.search("[A-Za-z]", t) and not re.search("AKIA|[0-9a-f]{24}", t)
    draw = lambda make: [t for t in (make(r) for _ in range(3000)) if usable(t)][:500]
    tokens = [(t, True) for t in draw(random_token)] + [(t, False) for t in draw(ordinary_token)]
    assert len(tokens) == 1000
    prose = [m.__doc__ + inspect.getsource(m) for m in (chat, centroids, spelling)]  # ordinary words and identifiers
    rows = [(i, f"see {t} there") for i, (t, _) in enumerate(tokens)] + [(2000 + i, t) for i, t in enumerate(prose)]
    found = {x.doc_id for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("n_random > 0").collect()}
    hits = sum(secret for i, (_, secret) in enumerate(tokens) if i in found)
    assert hits / 500 >= 0.9 and hits / len([i for i in found if i < 1000]) >= 0.9


def test_gaps_longer_than_an_edit_may_be(spark):
    """Lines that share long words in order, with gaps between them just within and just beyond the edits allowed."""
    keep, rows = "alphabetical conversation", []
    for k, n in enumerate(range(4, 40)):
        a, b = "".join(chr(97 + (i * 7 + k) % 13) for i in range(n)), "".join(chr(110 + (i * 5 + k) % 13) for i in range(n + k % 3))
        rows.append((k, f"{keep} {a} x {keep[::-1]} {'padding ' * 4}end", f"{keep} {b} {keep[::-1]} {'padding ' * 4}end"))
    df = spark.createDataFrame(rows, "u long, a string, b string")
    want = {r.u for r in df.where(1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")) >= line_dedup.SIMILARITY - 1e-12).collect()}
    assert {r.u for r in line_dedup.edit_similar(df, "a", "b").collect()} == want and 5 < len(want) < 31
