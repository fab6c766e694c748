"""Base spans and the lexer on small sources."""

import hashlib
import re

import pytest

from plumbline.llm.secrets import KINDS, base_spans, find_secrets, literal_score, name_score, named_spans


@pytest.mark.parametrize("text,spans", [
    ("", []),
    ("PassWord = 'abcdefgh'", [("assign", 0, 20)]),
    ("password=abcdefg token: 12345678", [("assign", 17, 32)]),
    ("secret: token: abcdefghi", []),
    ("api_key\":\"A/+_.=-b c", [("assign", 0, 18)]),
    ("é AKIA" + "A1" * 6 + "z AKIAB", [("access", 2, 18)]),
    ("deadbeef" * 4 + " " + "0" * 31, [("hex", 0, 32)]),
    ("token=" + "ab" * 20, [("assign", 0, 46), ("hex", 6, 46)]),
    ("ſecret=abcdefgh to\u212Aen=abcdefgh", []),
])
def test_base(text, spans):
    assert [(KINDS[k], a, b) for a, k, b in base_spans(text)] == spans


@pytest.mark.parametrize("text,found", [
    ('db_pwd = "hunter2-Q9!"', ["hunter2-Q9!"]),
    ('seed = "Zx81kQ0pLm"\nclientPassphrase = seed', ["Zx81kQ0pLm"]),
    ('a = "Zx81kQ"\nb = "0pLm77"\nAUTH_PASSPHRASE: str = a + b', ["Zx81kQ", "0pLm77"]),
    ("export DB_PWD=k3Jx9-22QpZz\n", ["k3Jx9-22QpZz"]),
    ("'privateKey' => 'MIIEvQIBADANBg9'", ["MIIEvQIBADANBg9"]),
    ('pwd_max_length = "1234567890"', []),
    ('credentials = "changeme-now"', []),
    ('title = "Zx81kQ0pLm"', []),
    ("He said: words, and the pin: well", []),
    ("passphrase == \"Zx81kQ0pLm\"", []),
])
def test_named(text, found):
    assert [text[a:b] for a, _, b in named_spans(text, base_spans(text))] == found


def test_constants_of_many_literals_and_long_names():
    parts = [f"{chr(97 + k)}{k % 10}" for k in range(24)]
    text = "seed = " + " + ".join(f'"{x}"' for x in parts) + "\ndb_pwd = seed"
    assert [text[a:b] for a, _, b in named_spans(text, [])] == parts
    text = "n" * 100 + '_pwd = "hunter2-Q9!"'
    assert [text[a:b] for a, _, b in named_spans(text, [])] == ["hunter2-Q9!"]
    text = 'a = "Zx81kQ0pLm"\n' + "a = a + a\n" * 2000 + "db_pwd = a"
    assert [text[a:b] for a, _, b in named_spans(text, [])] == ["Zx81kQ0pLm"]


def test_scores():
    assert name_score("userPassphrase") == 1 and name_score("color") == 0 and name_score("password_hint") < 0.5
    assert literal_score("short") == literal_score("your_password") == 0 and literal_score("k3Jx9-22QpZz") > 0.8


def slow(text):
    """The contract of the base kinds, read literally."""
    assign = [(m.start(), 0, m.end()) for m in re.finditer(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
                                                           r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    access = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    hexes = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(assign + access + hexes)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    total = 0
    for r in find_secrets(docs).collect():
        want = slow(texts[r.doc_id])
        base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert set(base.split(",")) <= set(r.spans.split(","))
        total += len(want)
    assert total > 20


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "token=abcdefghij"), (3, "x = " * 50_000 + "f" * 40), (3, "x"), (3, "x")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, spans string")
    got = find_secrets(df).collect()
    assert len(got) == 6 and sum(r.n_hex for r in got) == 1 and [r.n_assign for r in got if r.doc_id is None] == [1]
    assert find_secrets(df.limit(0)).collect() == []
