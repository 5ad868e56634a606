"""Personal data: base rules against plain regular expressions, bootstrapping against plain Python."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from cases import LONG, no_documents, odd_documents, texts

from sleevenotes.llm import pii, queries

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    d = [int(c) for c in digits(s)][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def good(kind, v):
    n = len(digits(v))
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 12 <= n <= 19 and luhn(v),
            "phone": lambda: 9 <= n <= 15}[kind]()


def base(text):
    found = [(m.start(), k, m.end(), kind) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text or "") if good(kind, m.group())]
    return sorted(found)


def spans(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append([(s.start, s.rank, s.end, s.kind, s.added) for s in r.spans])
    return out


def check_base(spark, rows):
    got = spans(pii.documents_spans(texts(spark, rows)))
    for k, text in rows:
        assert [s[:4] for s in got[k][0] if not s[4]] == base(text), text
    return got


CARD, BAD = "4111 1111 1111 1111", "4111 1111 1111 1112"
TRICKY = [
    "a.b@c.d.@e.f x_@y-z.co.uk..com @@a@b.c é@é.fr é.x@y.z", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.255 1.2.3.256 a1.2.3.4b", f"{CARD} {BAD} {CARD}",
    f"x{CARD}y\n{CARD.replace(' ', '-')}\t{CARD}", "+1 (523) 555-1055 +12 +1 ( ) 2345678 90 . + 1 +123456789012345678 +1-23\n456 7890 12",
    f"\U0001f600 tel:+1 (523) 555-1055, {CARD}\U0001f600 a@b.c1", "9" * 16 + " " + "9" * 40, "", " ", "@", "+", "4" * 5000, "1-" * 4000 + "1", "a@" * 3000,
    "a" * 3000, ("x" * 300 + ".") * 300 + "@b.c", "1." * 3000, "+1" + " " * 5000 + "2" * 9, "+1(" * 2000,
    " ".join(f"u{k}@mail.example.com {CARD}, 10.0.0.{k}" for k in range(400)),
]


def test_base_rules_are_those_of_plain_expressions(spark):
    check_base(spark, list(enumerate(TRICKY)))


def test_base_rules_on_random_texts(spark):
    rng = random.Random(7)
    pieces = ["0", "1", "25", "5", ".", ".", " ", " ", "-", "+", "(", ")", "@", "a", "\n", "é", "A%", CARD, "10.0.0.1"]
    check_base(spark, [(k, "".join(rng.choices(pieces, k=rng.randint(0, 40)))) for k in range(600)])


def test_long_texts_are_read_in_a_time_that_grows_with_them(spark):
    rows = [(0, "a" * 2_000_000), (1, "a@" * 500_000), (2, "12 " * 300_000), (3, "1.2.3.4 " * 50_000), (4, "+1(" * 300_000)]
    got = {r.doc_id: r.n for r in pii.documents_spans(texts(spark, rows)).selectExpr("doc_id", "size(spans) as n").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 50_000, 4: 0}


# -- bootstrapping ---------------------------------------------------------------------------------------------------

SPACE = " \t\n\x0b\f\r"
MARKED = r"[^ \t-\r0-9@]*[0-9@][^ \t-\r]*"


def words(s):
    return [w for w in re.split(r"[ \t-\r]+", s) if w]


def shape(v):
    v = re.sub(r"[^\W\d_]+", "a", v)
    for rule, mark in ((r"[0-9]{8,}", "L"), (r"[0-9]{4,7}", "M"), (r"[0-9]{1,3}", "S")):
        v = re.sub(rule, mark, v)
    return v


def form(v):
    hits = [good(k, v) for k in PLAIN if re.fullmatch(PLAIN[k], v)]
    return bool(hits) and not any(hits)


def plain_bootstrap(docs):
    """Added spans per document index, and the kept patterns."""
    slots, seeds = [], []
    for i, text in enumerate(docs):
        text = text or ""
        matches = list(re.finditer(rf"(?<![^ \t-\r]){MARKED}(?: [ ().-]*{MARKED})*", text))
        own = base(text)
        for at, m in enumerate(matches):
            low = matches[at - 1].end() if at else 0
            high = matches[at + 1].start() if at + 1 < len(matches) else len(text)
            around = lambda a, b: (text[max(low, m.start() - 48) : a], text[b : min(high, m.end() + 48)])  # noqa: E731, B023
            inside = [s for s in own if m.start() <= s[0] < m.end()]
            if inside:
                a, k, b, _ = inside[0]
                seeds.append((text[a:b].lower(), *around(a, b), shape(text[a:b]), k))
                continue
            pieces = [(0, m.start(), m.group())]
            if " " in m.group():
                pieces += [(n + 1, m.start() + w.start(), w.group()) for n, w in enumerate(re.finditer("[^ ]*", m.group()))]
            for part, a, v in pieces:
                head = re.match(r"^(?:[A-Za-z_-]+[:=])?[^A-Za-z0-9+(]*", v).end()
                name = re.sub(r"[^A-Za-z0-9)]+$", "", v[head:])
                if (len(digits(name)) >= 5 or "@" in name) and len(name) <= 64:
                    a, b = a + head, a + head + len(name)
                    slots.append((i, at, part, a, b, name.lower(), *around(a, b), shape(name), form(name)))

    def patterns(before, after, shp):
        zero = str.maketrans("123456789", "0" * 9)
        left, right = words(before.lower().translate(zero)), words(after.lower().translate(zero))
        l1, l2 = (left[-1] if left else "^"), (left[-2] if len(left) > 1 else "^")
        return [f"{l2} {l1} _", f"{l1} _ {right[0] if right else '$'}", f"{l1} _ like {shp}"]

    first = {}
    for v, *_, k in seeds:
        first[v] = min(k, first.get(v, 9))
    edges, open_ = defaultdict(set), defaultdict(set)
    barred = {s[5] for s in slots if s[9]}
    for v, before, after, shp, _ in seeds:
        for p in patterns(before, after, shp):
            edges[p].add(v)
    for s in slots:
        for p in patterns(*s[6:9]):
            edges[p].add(s[5])
            if s[5] not in first and s[5] not in barred:
                open_[s[5]].add(p)

    def scores(known):
        out = {}
        for p, values in edges.items():
            sums = [sum(known[v][1] for v in values if v in known and known[v][0] == k) for k in range(4)]
            k = max(range(4), key=lambda k: (sums[k], -k))
            conf = round(sums[k] / (len(values) + 1), 9)
            if sums[k] >= pii.SUPPORT and conf >= pii.CONFIDENCE:
                out[p] = (k, conf)
        return out

    known, n = {v: (k, 1.0) for v, k in first.items()}, -1
    kept = scores(known)
    for _ in range(pii.ROUNDS):
        new = {}
        for v, ps in open_.items():
            doubt = defaultdict(lambda: 1.0)
            for p in ps & set(kept):
                doubt[kept[p][0]] *= 1 - kept[p][1]
            if doubt:
                k, d = min(doubt.items(), key=lambda x: (round(x[1], 9), x[0]))
                if round(1 - d, 9) >= pii.CONFIDENCE:
                    new[v] = (k, round(1 - d, 9))
        known = {v: (k, 1.0) for v, k in first.items()} | new
        if len(new) == n or not new:
            break
        n, kept = len(new), scores(known)
    found = [s for s in slots if not s[9] and s[5] in known]
    whole = {s[:2] for s in found if s[2] == 0}
    added = defaultdict(list)
    for s in found:
        if s[2] == 0 or s[:2] not in whole:
            added[s[0]].append((s[3], known[s[5]][0], s[4], pii.KINDS[known[s[5]][0]], True))
    return added, kept


def corpus():
    out = [f"please call me at +1 (523) 555-{1000 + k} now, thanks {k % 3}" for k in range(100)]
    out += [f"please call me at (523) 777-{1000 + k} now, ok" for k in range(18)]  # in the first round
    out += [f"fax line (523) 777-{1000 + k} is open" for k in range(18)] + ["fax line (523) 888-1111 is open"]
    out += ["fax line (523) 999-2222 is closed"] * 2
    out += [f"my card no {c} expires" for c in (CARD, "5500 0000 0000 0004", "340000000000009", "30000000000004", "6011000000000004", "4012888888881881")]
    out += [f"my card no {c} expires" for c in (BAD, "4111111111111112")] + ["my card no AB123456 expires", "order AB123456 today", "order ZZ98765 today"]
    out += [f"version {k}.{k}.{k} of 2021, 10:30, item {k * 111} costs 12345" for k in range(9)]
    out += [f"twice {CARD} 5500000000000004 here", "write to user7 (at) host99.com", LONG, "", None]
    return out + [f"mail <user{k}@mail.example.com> soon" for k in range(20)] + ["mail <user17@localhost> soon", "mail <user18@localhost> soon"]


def test_bootstrapping_is_that_of_plain_python(spark):
    docs = corpus()
    want, kept = plain_bootstrap(docs)
    out = pii.extracted(texts(spark, list(enumerate(docs))))
    assert {r.pattern: (r.rank, pytest.approx(r.confidence)) for r in out.patterns.collect()} == kept
    got = spans(pii.documents_spans(texts(spark, list(enumerate(docs)))))
    for k in range(len(docs)):
        assert [s for s in got[k][0] if s[4]] == sorted(want[k]), docs[k]
        assert [s[:4] for s in got[k][0] if not s[4]] == base(docs[k])
    added = {docs[k][s[0] : s[2]] for k in want for s in want[k]}
    assert {"(523) 777-1000", "(523) 888-1111", "(523) 999-2222", "user17@localhost"} <= added  # patterns of the second round, too
    assert not {a for a in added if BAD[-4:] in a or "12345" in a or a.startswith(("item", "version"))}
    assert math.isclose(max(c for _, c in kept.values()), max(r.confidence for r in out.patterns.collect()))


def test_odd_documents(spark):
    odd = odd_documents(spark)
    out = pii.documents_spans(odd.repartition(5)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect())
    assert all([s.start for s in r.spans] == sorted(s.start for s in r.spans) for r in out)
    assert pii.documents_spans(no_documents(spark)).count() == 0
    keyed = odd.selectExpr("concat('k', doc_id) as doc_id", "text")
    assert pii.documents_spans(keyed).count() == odd.count()


def test_query_is_that_of_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, _ = plain_bootstrap([t for _, t in docs])
    got = {r.doc_id: r for r in queries.op13_pii(spark, SF).collect()}
    assert len(got) == len(docs)
    text = lambda found: ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in sorted(found))
    for k, (i, t) in enumerate(docs):
        own = base(t)
        assert got[i].base_sha256 == hashlib.sha256(text(own).encode()).hexdigest()
        assert [got[i][f"n_{kind}"] for kind in pii.KINDS] == [sum(s[3] == kind for s in own) for kind in pii.KINDS]
        assert got[i].spans == text([*own, *(s[:4] for s in want[k])])
