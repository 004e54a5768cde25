import hashlib
import random
import re
import string

from tillmark.llm import secret_scan as own

BASE = (
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def plain(text):
    found = [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for n, (kind, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    return [s for *_, s in sorted(found)]


def secret(rnd, size=32, letters=string.ascii_letters + string.digits):
    return "".join(rnd.choice(letters) for _ in range(size))


def texts():
    rnd = random.Random(4)
    pieces = [
        "password", "PassWD", "secret", "ToKen", "api_key", "APIKEY", "toKen", "ſecret", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA",
        "0123456789ABCDEFG", "abcdef0123456789", "deadbeef" * 4, "x", "é", "中", "\n", "+/_.-=", "value", "A" * 12, "f" * 31, "f" * 32,
    ]
    made = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 30))) for _ in range(300)]
    long = "token " * 40_000 + "secret = " + "k" * 50_000 + " " * 100_000 + "f" * 70_000
    return [None, "", " ", "token=12345678", "token=1234567", long, *made, made[3]]


def test_base_spans_equal_the_patterns(documents):
    given = texts()
    got = {r["doc_id"]: r for r in own.report(documents(given)).collect()}
    assert len(got) == len(given)
    for i, t in enumerate(given, 1):
        spans = plain(t)
        row = got[i]
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == tuple(sum(s.startswith(k) for s in spans) for k, *_ in BASE)
        assert row["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        all_spans = [s for s in row["spans"].split(",") if s]
        assert [s for s in all_spans if not s.startswith("novel")] == spans
        assert [int(s.split(":")[1]) for s in all_spans] == sorted(int(s.split(":")[1]) for s in all_spans)


CODE = [
    "def load_account_settings(self):\n    return self.repository.loadAccountSettings(self.account_identifier)\n",
    "connectionTimeoutMilliseconds = configuration.connectionTimeoutMilliseconds\n",
    "class RepositoryConfigurationManager: maximumConnectionAttempts = defaultConnectionAttempts\n",
]


def test_new_strings_in_sensitive_places_are_reported(documents):
    rnd = random.Random(6)
    prose = "The quick brown fox writes internationalization guidelines for the authorization of repositories. "
    keys = [secret(rnd, size) for size in range(20, 60)]
    planted = [f"{rnd.choice(CODE)}bearer {k}\n{rnd.choice(CODE)}" for k in keys]
    twice = f"private key {keys[0]} and the private key {keys[0]} again"
    clean = [
        f"credential: loadAccountSettings, auth by connectionTimeoutMilliseconds {code}the key RepositoryConfigurationManager" for code in CODE
    ]
    away = [f"{prose}All of them are numbered and named: {k} {prose}" for k in keys]
    edges = [f"key é{keys[1]}", f"key {keys[1]}é", "key " + "0" * 40, "key " + "ab" * 30, "key " + "-" * 50]
    given = [prose * 3, prose, *CODE, *[c + prose for c in CODE], *planted, *clean, *away, *edges, twice, None, ""]
    rows = {r["doc_id"]: r for r in own.find(documents(given)).collect()}

    def novel(i):
        return [(given[i][s["start"] : s["end"]], s["novelty"]) for s in rows[i + 1]["spans"] if s["kind"] == "novel"]

    first = given.index(planted[0])
    hits = sum([k for k, _ in novel(first + n)] == [key] for n, key in enumerate(keys))
    assert hits >= 0.95 * len(keys)
    others = [i for i, t in enumerate(given) if t in clean + away + edges + [prose, prose * 3] + CODE]
    assert [novel(i) for i in others if novel(i)] == []
    assert [k for k, _ in novel(given.index(twice))] == [keys[0], keys[0]]
    assert all(n >= own.NOVEL for i in range(len(given)) if given[i] for _, n in novel(i))


def test_a_key_in_many_copies_is_still_new(documents):
    rnd = random.Random(7)
    text = f"{CODE[0]}signature {secret(rnd, 40)}"
    rows = own.report(documents([text] * 50 + [text + " x"] * 20 + CODE)).collect()
    assert [r["n_novel"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [1] * 70 + [0] * 3


def test_redaction_removes_every_span(documents):
    rnd = random.Random(8)
    key = secret(rnd, 40)
    given = [f"a token = 'abcdef123' é {'0a' * 20} bearer {key}, AKIA{'B' * 16}", None, "clean é"]
    got = {r["doc_id"]: r["text"] for r in own.redact(documents(given)).collect()}
    assert got == {1: "a [ASSIGN]' é [HEX] bearer [NOVEL], [ACCESS]", 2: "", 3: "clean é"}


def test_empty_table(documents, spark):
    assert own.report(documents(["x"]).limit(0)).collect() == own.redact(documents(["x"]).limit(0)).collect() == []
