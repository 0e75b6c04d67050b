from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from groundwell.llm import op9_secrets as op

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def naive(text: str) -> list[tuple]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], op.KINDS.index(s[2])))


def lexed(text: str) -> list[str]:
    return [text[a:b] for a, b, _ in sorted(op.lexed_spans(text))]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(9)
    parts = ["token", "SECRET", "password", "api_key", "apiKey", "passwd", " ", "  ", "=", ":", '"', "'", "abcdef", "a1b2c3", "0123456789abcdef01234567", "AKIA", "AKIA" + "Z9" * 9, "é", "ſecret", "toKen", "\n", "x", "-_/+"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert sorted(op.base_spans(text), key=lambda s: (s[0], op.KINDS.index(s[2]))) == naive(text)
        assert [s for s in op.find_spans(text) if s[2] != "lexed"] == naive(text)


def test_the_lexer_finds_literals_by_the_names_they_reach():
    assert lexed('db_pwd = "hunter2Hunter2"') == ["hunter2Hunter2"]
    assert lexed("<clientSecret>Zx81Zx81Zx81</clientSecret>") == ["Zx81Zx81Zx81"]
    assert lexed("'auth_token' => 'q9W8e7R6t5'") == ["q9W8e7R6t5"]
    assert lexed('export BEARER_CREDENTIAL=qwe123QWE456') == ["qwe123QWE456"]


def test_constants_are_propagated():
    assert lexed('A = "p4ssP4ss99"\nlogin_password = A') == ["p4ssP4ss99"]
    assert lexed('X = "first1A"\nY = X\nsecret_value = Y') == ["first1A"]
    assert lexed('P = "abcD12"\npassphrase = P + "efgH34"') == ["abcD12", "efgH34"]
    assert lexed('A = "p4ssP4ss99"\nlogin_name = A') == []


def test_harmless_names_and_placeholders_are_left_alone():
    for text in ("password_policy = strictstrict", 'token_count = "123456"', 'password = "changeme"', "secret: ********", "the password is long", 'key = "ordinary"', ""):
        assert lexed(text) == [], text


def test_nothing_is_too_long_to_be_read():
    long = "aB3" * 700
    assert lexed(f'private_key = "{long}"') == [long]
    assert lexed(f"private_key = '{long}'") == [long]
    assert lexed(f"private_key = {long}") == [long]
    assert op.redact(f"private_key = {long} end") == "private_key = [secret] end"
    assert lexed(f"<private_key>{long}</private_key>") == [long]
    assert lexed("private_key" + " " * 20 + "=" + " " * 20 + f'"{long}"') == [long]
    name = "x_" * 100 + "private_key"
    assert lexed(f'{name} = "{long}"') == lexed(f"<{name}>{long}</{name}>") == [long]
    assert lexed(f'--db-pwd="{long}"') == lexed(f'1.db_pwd="{long}"') == [long]


def test_a_name_holds_any_number_of_literals():
    terms = [f"p4ssP4ss{k:02}" for k in range(20)]
    assert lexed("db_pwd = " + (" " * 20 + "+" + " " * 20).join(f'"{t}"' for t in terms)) == terms
    lines = "".join(f'{"x_" * 50}{k} = "{t}"\n' for k, t in enumerate(terms))
    assert lexed(lines + "db_pwd = " + " + ".join(f'{"x_" * 50}{k}' for k in range(20))) == terms
    assert lexed('A = "p4ssP4ss99"\n' + "A = A + A\n" * 200 + "db_pwd = A") == ["p4ssP4ss99"]


def test_uncapped_lexing_takes_linear_time():
    n = 40_000
    grown = lexed('A = ""\n' + 'A = A + "p4ssP4ss99"\n' * n + "db_pwd = A")
    assert grown == ["p4ssP4ss99"] * n
    for text in ("a-b." * 250_000, "key" + " " * 1_000_000, "key =" + " " * 1_000_000, "key=a" + " + a" * 250_000, 'key="' + "a" * 1_000_000, """key="'""" * 200_000, "<key>aaaaaa" * 100_000, "<" + "k" * 1_000_000, "key = a + '" * 100_000):
        op.lexed_spans(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
    (r'db_pwd = "hun\nter2Hunter2"', [r'hun\nter2Hunter2']),
    ('db_pwd = """hunter2Hunter2"""', ['hunter2Hunter2']),
    ("db_pwd = '''\nhunter2\nHunter2\n'''", ["\nhunter2\nHunter2\n"]),
    ('pwd: |\n  hunter2Hunter2\nother: x', ['hunter2Hunter2']),
    ('db_pwd = f"hunter2Hunter2"', ['hunter2Hunter2']),
    ('DB=hunter2Hunter2\nPASSWORD_VALUE=${DB}', ['hunter2Hunter2']),
    ('login_password = A\nA = "p4ssP4ss99"', ['p4ssP4ss99']),
    ('api_access_client = "Zx81Zx81Zx81"', ['Zx81Zx81Zx81']),
    ('encryption_signing_client = "Zx81Zx81Zx81"', ['Zx81Zx81Zx81']),
    ('PASSWORD_VALUE=${DB:-fallback1A}', ['fallback1A']),
    ('db_pwd: str = "hunter2Hunter2"', ['hunter2Hunter2']),
    ('config["db_pwd"] = "hunter2Hunter2"', ['hunter2Hunter2']),
    ('char db_pwd[] = "hunter2Hunter2";', ['hunter2Hunter2']),
    (r'{\"db_pwd\": \"hunter2Hunter2\"}', ['hunter2Hunter2']),
    ('x = "{\\"db_pwd\\": \\"hunter2Hunter2\\"}"', ['hunter2Hunter2']),
    ('define("DB_PASSWD", "hunter2Hunter2")', ['hunter2Hunter2']),
    ('- name: DB_PASSWORD\n  value: hunter2Hunter2', ['hunter2Hunter2']),
    ('<add key="db_pwd" value="hunter2Hunter2"/>', ['hunter2Hunter2']),
    ('db_pwd = os.getenv("DB_PWD_NAME", "fallback1A")', ['fallback1A']),
    ('db_pwd = os.environ["DB_PWD_NAME"]', []),
    ('tokens_secret = ["abc123DEF", "q9W8e7R6"]', ['abc123DEF','q9W8e7R6']),
    ('db_pwd = /* note: x */ "hunter2Hunter2"', ['hunter2Hunter2']),
    ('db_pwd = (  # why\n "hunter2"\n "Hunter2")', ['hunter2','Hunter2']),
    ('def f():\n    k = "aaaBBB111"\ndef g():\n    k = "cccDDD222"\n    db_pwd = k\n', ['cccDDD222']),
    ('k = "aaaBBB111"\ndef g():\n    db_pwd = k\n', ['aaaBBB111']),
    ('[a]\nk = aaaBBB111\n[b]\nk = cccDDD222\ndb_pwd = ${k}\n', ['cccDDD222']),
    ("he said: don't use pwd: it's hunter2Hunter2", []),
    ('conn = "Server=x;Pwd=hunter2Hunter2;"', ['hunter2Hunter2']),
    ('db_pwd = `hunter2\nHunter2`', ['hunter2\nHunter2']),
    ('db_pwd += "hunter2Hunter2"', ['hunter2Hunter2']),
    ('db_pwd = x || "hunter2Hunter2"', ['hunter2Hunter2']),
    ('db_pwd =\n    "hunter2Hunter2"', ['hunter2Hunter2']),
    ('db_pwd:\n  "host": hunter2Hunter2', []),
    ('db_pwd == "hunter2Hunter2"', []),
    ('self.db_pwd = Config.K\nclass Config:\n    K = "hunter2Hunter2"', ['hunter2Hunter2']),
    ('db_pwd = "%(A)s"\nA: hunter2Hunter2', ['hunter2Hunter2']),
    ('bot_token = 12345:AAHxyzzz', ['12345:AAHxyzzz']),
    ('db_pwd = pässwort12A', ['pässwort12A']),
    ('private_key: >-\n    -----BEGIN PRIVATE KEY-----\n    MIIabc123\n    -----END PRIVATE KEY-----\nx: 1', ['-----BEGIN PRIVATE KEY-----\n    MIIabc123\n    -----END PRIVATE KEY-----']),
    ('db_pwd = "hunter2$ABChunter"', ['hunter2$ABChunter']),
    ('db_pwd = "abc\\\ndef123G"', ['abc\\\ndef123G']),
    ('db_pwd = "hunter2Hunter2', ['hunter2Hunter2']),
    ],
)
def test_syntax_of_sources_and_configurations(text, want):
    assert lexed(text) == want


def test_names_that_scores_accept_are_never_skipped():
    for name in ("api_access_client", "encryption_signing_client", "authKey", "session_cert_signing"):
        assert op.name_score(name) + op.BEST_FORM >= op.THRESHOLD
        assert lexed(f'{name} = "Zx81-Zx81-Zx81-Zx81-Zx81-Zx81"') == ["Zx81-Zx81-Zx81-Zx81-Zx81-Zx81"]
    assert max(op.form_score(v) for v in ("aB3" * 400, "aB3aB3", "ab" * 30)) <= op.BEST_FORM


def test_ten_thousand_characters():
    long = "aB3x" * 2500
    for text in (f'k = "{long}"\ndb_pwd = k', f'db_pwd = """{long}"""', f"pwd: |\n  {long}\n", f"db_pwd = {long}", f"db_pwd = ${{X:-{long}}}", f'db_pwd = f("{long}")'):
        assert lexed(text) == [long]


def seconds(text: str) -> float:
    best = 1e9
    for _ in range(2):
        began = time.process_time()
        op.find_spans(text)
        best = min(best, time.process_time() - began)
    return best


#: Pieces whose repetition would take quadratic time in a reader that goes back.
PIECES = [
    "token=", "a-b.", "key=a + ", 'x="', "secret ", "<secret>", "<key>aaaaaa", "token = /* b = ", "token = # b = ", "token = f(a=f(", "token = ((((", "token=\"\"\"b='''", 'token=\\"a=', "token = ${A:-", "token: |\n", "token:\n\n",
    'token = "a=" + ', "token = a\na = token\n", "def f():\n token = a\n a='x'\n", "token = {{ ", "token=`a=", "token = 'b=\" + ", "name: x value: y ", "(\"token\", ", "token:a", "key = a + '", "pwd: |\n ",
]


@pytest.mark.parametrize("piece", PIECES)
def test_time_is_linear(piece):
    n = 30_000 // len(piece)
    short, long = seconds(piece * n), seconds(piece * (8 * n))
    assert long < 24 * short + 0.2  # 8 in proportion, 64 if it were quadratic


def test_redaction_masks_every_span():
    text = 'a token = "0123456789abcdef0123456789" b'
    assert op.redact(text) == 'a [secret]" b'
    assert op.redact(None) is None
    assert op.redact("clean text") == "clean text"


def test_tables(spark, docs, texts, odd_docs, no_docs):
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in op.scan(docs).collect()}
    assert got == {d: op.find_spans(t or "") for d, t in texts.items()}
    assert sorted(r.doc_id for r in op.scan(odd_docs).collect()) == [1, 1, 2, 3, 3]
    assert op.scan(no_docs).count() == 0


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op.query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = naive(texts[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in spans) for k in op.KINDS[:3])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, b, k in op.find_spans(texts[r.doc_id] or ""))
