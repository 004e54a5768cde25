import hashlib
import re
from collections import Counter
from math import log, sqrt

from tillmark.llm import private_data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    rules = (
        ("email", EMAIL, lambda m: True),
        ("ip", IP, lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        ("card", CARD, lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", PHONE, lambda m: 10 <= len(digits(m)) <= 15),
    )
    return sorted((m.start(), n, m.end(), kind, m.group()) for n, (kind, p, ok) in enumerate(rules) for m in p.finditer(text) if ok(m))


def words_of(text):
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        word = re.sub(r"^[\W_]+|[\W_]+$", "", m.group().lower())
        if word:
            yield m.start() + m.group().lower().index(word), word


def wilson(hits, count):
    """The smaller root of (hits / count - x)^2 = z^2 x (1 - x) / count."""
    z = private_data.CONFIDENCE**2
    a, b, c = 1 + z / count, -(2 * hits / count + z / count), (hits / count) ** 2
    return (-b - sqrt(b * b - 4 * a * c)) / (2 * a)


def by_hand(texts):
    """Base spans of every text, and the words that disclose one of its entities."""
    texts = [t or "" for t in texts]
    entities = [{f"{s[3]}:" + (s[4] if s[1] < 2 else re.sub("[^0-9]", "", s[4])) for s in base(t)} for t in texts]
    once = {t: (e, {w for _, w in words_of(t)}) for t, e in zip(texts, entities)}
    n, by_entity, by_term, by_both = len(once), Counter(), Counter(), Counter()
    for e, w in once.values():
        by_entity.update(e)
        by_term.update(w)
        by_both.update((a, b) for a in e for b in w)
    share = {
        (e, t): log(n * wilson(c, by_term[t]) / by_entity[e]) / log(n / by_entity[e])
        for (e, t), c in by_both.items()
        if by_entity[e] < n
    }
    out = []
    for text, own in zip(texts, entities):
        first = base(text)
        spans = [(a, n, b) for a, n, b, *_ in first]
        for at, word in words_of(text):
            if any(share.get((e, word), 0) >= private_data.GENERALISE for e in own):
                if not any(a < at + len(word) and at < b for a, _, b in ((s[0], 0, s[2]) for s in first)):
                    spans.append((at, 4, at + len(word)))
        out.append((first, sorted(spans)))
    return out


def write(spans):
    return ",".join(f"{private_data.KINDS[n]}:{a}:{b}" for a, n, b in spans)


TEXTS = [
    None,
    "",
    "no data here",
    "ü mail bob.smith@example.co.uk, or x@y.z_k@w.v or a@b@c.d @e.f g@h",
    "1.2.3.4.5.6.7.8 and 256.1.1.1 1.1.1.1000 0001.002.3.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111  1111 12 34567890123456789012345",
    "+49 (30) 1234-5678 and +1 2 and +12.34.56.78.90.12 +1234567890123456 ++1 555 555 0100.",
    "😀 after an astral sign joe@x.org +44 20 7946 0958, 10.0.0.1",
    "9" * 30_000 + " " + "a" * 30_000 + " " + "1 " * 20_000 + "." * 5000,
    " ".join(f"user{i}@host{i}.com" for i in range(300)),
] + [f"(Zorblax!) wrote text{i} to agent@secret.org about ordinary things, zorblax {i}" for i in range(8)]
TEXTS += [f"ordinary things number {i} were said about nothing" for i in range(300)] + [TEXTS[-1]]


def test_spans_equal_brute_force(documents):
    got = {r["doc_id"]: r for r in private_data.report(documents(TEXTS)).collect()}
    want = by_hand(TEXTS)
    assert len(got) == len(TEXTS)
    for key, (first, spans) in enumerate(want, 1):
        row = got[key]
        counts = Counter(s[3] for s in first)
        assert [row[f"n_{k}"] for k in private_data.PATTERNS] == [counts[k] for k in private_data.PATTERNS], key
        assert row["base_sha256"] == hashlib.sha256(write([(a, n, b) for a, n, b, *_ in first]).encode()).hexdigest(), key
        assert row["spans"] == write(spans), key
    assert any("term" in r["spans"] for r in got.values())


def test_sanitised_text(documents):
    rows = {r["doc_id"]: r["text"] for r in private_data.sanitise(documents(TEXTS)).collect()}
    assert rows[1] == "" and rows[3] == "no data here"
    assert rows[8] == "😀 after an astral sign [EMAIL] [PHONE], [IP]"
    assert "orblax" not in rows[11] and "agent@" not in rows[11] and "ordinary things" in rows[11]


def test_rare_entities_and_pools(documents):
    """An entity in three texts, and a mail domain in five of which no address occurs twice."""
    plain = [f"nothing at all is said here, line {i}" for i in range(3000)]
    rare = [f"Quimby number {i} can be had at q.uimby@rare.org at once" for i in range(3)]
    pooled = [f"staff {i} of Vandelay write from desk{i}@latex.com every day" for i in range(5)]
    got = {r["doc_id"]: r for r in private_data.spans(documents(plain + rare + pooled)).where("doc_id > 3000").collect()}
    told = {k: {r["text"][s["start"] : s["end"]] for s in r["term"]} for k, r in got.items()}
    assert all("Quimby" in told[k] and "number" in told[k] for k in (3001, 3002, 3003))
    assert all("Vandelay" in told[k] for k in range(3004, 3009))
    assert all("nothing" not in t for t in told.values())


def test_empty_table(documents):
    assert private_data.report(documents([])).count() == 0
