"""Column expressions and readers on small examples."""

from __future__ import annotations

import hashlib
import json
import random
import string

import pytest
from pyspark.sql import functions as F

from codelode.config import Settings
from codelode.functions import paths, redaction, text, vectors
from codelode.operators import chunk, readers
from codelode.sources import repos


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "path,size,reason",
    [
        ("a/b.py", 10, None), ("a/b.PY", 10, None), ("b.rs", 10, "extension"), (".ts", 10, "extension"), ("vendor/a.js", 1, "excluded_dir"), ("a/Vendor/a.js", 1, None),
        ("vendor.py", 1, None), ("a/x.MIN.js", 1, "generated"), ("p_pb2.py", 1, "generated"), ("a.py", 512001, "too_large"), ("a.py", 512000, None), ("n.IPYNB", 512001, None),
        ("n.ipynb", 10485761, "too_large"), ("a.md", 0, "empty"), ("dist/a.min.js", 0, "excluded_dir"),
    ],
)
def test_skip_reason(spark, path, size, reason):
    assert one(spark, paths.skip_reason(F.col("p"), F.col("s")), p=path, s=size) == reason


@pytest.mark.parametrize(
    "url,slug",
    [
        ("https://github.com/Own/Name", "own__name"), ("http://www.github.com/o/n/tree/x/", "o__n"), (" o/n.git ", "o__n"), ("git@github.com:o/n.git", "o__n"), ("o/n/", "o__n"),
        ("https://example.com/o/n", None), ("o", None), ("o/..", None), ("./n", None), ("", None), ("o/.git", None),
    ],
)
def test_parse_repo_urls(spark, url, slug):
    row = repos.parse_repo_urls(spark.createDataFrame([(url,)], "url string")).first()
    assert row.slug == slug and (row.error is None) == (slug is not None)


def test_hashes_and_texts(spark):
    raw = b"hello\xffw\n"
    assert one(spark, text.git_blob_sha(F.col("c")), c=bytearray(raw)) == hashlib.sha1(b"blob %d\0" % len(raw) + raw).hexdigest()
    assert one(spark, text.decode_text(F.col("c")), c=bytearray(raw)) == raw.decode(errors="replace")
    assert one(spark, text.decode_text(F.col("c")), c=bytearray(b"a\0b")) is None
    assert one(spark, text.decode_text(F.col("c")), c=bytearray(b"a" * 9000 + b"\0")) is not None
    assert one(spark, text.line_count(F.col("t")), t="a\nb\n") == 2 and one(spark, text.line_count(F.col("t")), t="a\nb") == 2
    assert one(spark, text.entropy(F.col("t")), t="aabb") == pytest.approx(1.0)
    assert one(spark, text.clean_output(F.col("t")), t="\x1b[31mred\x1b[0m  \n10%\r99%\n\n" + "x" * 301) == "red\n99%\n" + "x" * 300 + " ..."
    long = one(spark, text.clean_output(F.col("t")), t="\n".join(map(str, range(100)))).split("\n")
    assert long[14:17] == ["14", "... [70 lines omitted]", "85"] and len(long) == 31
    assert one(spark, text.excerpt(F.col("t")), t=" \n ") is None


def test_vectors(spark):
    assert one(spark, vectors.bucket_of(F.col("w"), 97), w="water") == int(hashlib.md5(b"water").hexdigest(), 16) % 97
    assert one(spark, vectors.l2_normalize(F.col("v")), v=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.l2_normalize(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, vectors.cosine(F.col("v"), F.col("w")), v=[0.0, 0.0], w=[1.0, 0.0]) == 0


def word(n: int, letters: str = string.ascii_letters + string.digits) -> str:
    return "".join(random.Random(n).choice(letters) for _ in range(n))


#: Put together here, so that no file holds anything that looks like a secret.
SECRETS = {
    "aws_access_key": "AKIA" + word(16, string.ascii_uppercase), "github_token": "ghp_" + word(36), "openrouter_key": "sk-" + "or-" + word(24), "anthropic_key": "sk-" + "ant-" + word(25),
    "openai_key": "sk-" + word(26), "stripe_key": "sk_" + "live_" + word(17), "slack_token": "xoxb-" + word(12), "google_api_key": "AIza" + word(35), "huggingface_token": "hf_" + word(31),
    "jwt": ".".join(("eyJ" + word(11), "eyJ" + word(12), word(13))),
}


@pytest.mark.parametrize("kind", SECRETS)
def test_formats(kind):
    assert redaction.redacted(f"x {SECRETS[kind]} y") == (f"x [REDACTED:{kind}] y", {kind: 1})


def test_redaction_keeps_lines(spark):
    key = "-----BEGIN RSA PRIVATE " + "KEY-----\nabc\ndef\n-----END RSA PRIVATE " + "KEY-----"
    source = f'a\n{key}\nb = 1\npassword = "q8Zr5tXw2LmP"\npostgres://u:q8Zr5tXw2LmP@h/d\nmail me@corp.io, you@mail3.example.com, git@host.io\n'
    done, found = redaction.redacted(source)
    assert done.count("\n") == source.count("\n") and "q8Zr" not in done and "me@corp" not in done and "you@mail3.example.com" in done and "git@host.io" in done
    assert found == {"private_key": 1, "credential_assignment": 1, "connection_string_password": 1, "email": 1}
    row = redaction.redact_documents(spark.createDataFrame([(source,), (None,)], "text string")).collect()
    assert row[0].text == done and row[0].findings == found and row[1].text is None
    assert one(spark, redaction.redact_emails(F.col("t")), t="a@x.example.com b@x.example c@y.org.uk") == "a@x.example.com [REDACTED:email] [REDACTED:email]"


@pytest.mark.parametrize("line", ['password = "changeme-now"', 'token = "your-token-here"', 'secret: "${SECRET_VALUE}"', "password = input()", 'api_key = "aaaaaaaaaaaa"', "http://host:80/x@y", "see a@localhost"])
def test_benign(line):
    assert redaction.redacted(line) == (line, {})


def test_python_units():
    source = "@a\n@b\ndef f():\n    def g(): pass\n    if 1:\n        def h(): pass\nclass C:\n    async def m(self):\n        pass\n"
    assert readers.definitions(source) == [(1, 6, "def f", 0), (4, 4, "def f > def g", 1), (7, 9, "class C", 0), (8, 9, "class C > def m", 1)]
    assert readers.definitions("print 'old'") == []


def test_markdown_units(spark):
    source = "intro\n# A #\ntext\n### B\n```\n# no\n```\n## C\n# D\nend\n"
    df = spark.createDataFrame([("k", source)], "key string, text string")
    got = readers.markdown_units(readers.lines_of(df, ["key"]), ["key"]).orderBy("start_line").collect()
    assert [tuple(r)[1:] for r in got] == [(2, 8, "A", 0), (4, 7, "A > B", 1), (8, 8, "A > C", 1), (9, 10, "D", 0)]


def test_notebooks(spark):
    cells = [
        {"cell_type": "markdown", "source": ["# T\n", "text\n"]},
        {"cell_type": "code", "source": "x = 1", "outputs": [
            {"output_type": "stream", "name": "stdout", "text": ["one\n", "two\n"]}, {"output_type": "stream", "name": "stderr", "text": "warn"},
            {"output_type": "execute_result", "data": {"text/html": "<b>h</b>", "image/png": "..."}}, {"output_type": "error", "ename": "E", "evalue": "v"}]},
        {"cell_type": "code", "source": "", "outputs": []},
    ]
    old = {"worksheets": [{"cells": [{"cell_type": "code", "input": "y", "outputs": [{"output_type": "pyout", "text/plain": "3"}]}]}]}
    rows = [("a.ipynb", "1", json.dumps({"cells": cells})), ("b.ipynb", "2", json.dumps(old)), ("c.ipynb", "3", "not json")]
    df = spark.createDataFrame([("r", *r) for r in rows], "repo string, path string, blob_sha string, text string")
    got = {r.path: r for r in readers.read_documents(df).collect()}
    assert got["a.ipynb"].text.split("\n") == ["# [cell 1 · markdown]", "# T", "text", "", "# [cell 2 · code]", "x = 1", "# [output of cell 2]", "one", "two", " h", "[image output: png]", "E: v", ""]
    assert [tuple(u) for u in got["a.ipynb"].units] == [(1, 3, "cell 1", 0), (5, 12, "cell 2", 0)]
    assert got["b.ipynb"].text.split("\n")[1:4] == ["y", "# [output of cell 1]", "3"] and got["c.ipynb"].text == "not json" and not got["c.ipynb"].units


SMALL = Settings(piece_tokens=40, overlap_tokens=5, context_tokens=150)


def module(n: int) -> str:
    return "\n".join(f"def f{i}(a, b):\n    x = a + b\n    y = x * 2\n    return y\n" for i in range(n))


@pytest.mark.parametrize("source,language", [(module(60), "python"), ("\n\n\n" + module(30), "javascript"), ("word " * 900, "text"), ("x" * 50 + " " + "long " * 300 + "\n# H\n" * 50, "markdown")])
def test_chunks(spark, source, language):
    path = {"python": "a.py", "javascript": "a.js", "text": "a.txt", "markdown": "a.md"}[language]
    df = spark.createDataFrame([("r", path, "sha", language, source)], "repo string, path string, blob_sha string, language string, text string").withColumn("units", F.lit(None).cast(chunk.UNITS))
    got = chunk.chunk_documents(df, SMALL).orderBy("chunk_index").collect()
    lines = source.split("\n")
    assert [r.chunk_index for r in got] == list(range(len(got))) and len({r.id for r in got}) == len(got) > 3
    assert all(a.start_line <= b.start_line for a, b in zip(got, got[1:]))
    for r in got:
        assert chunk.words(r.text) <= 40 and r.text in "\n".join(lines[r.start_line - 1 : r.end_line])
        assert r.parent_start_line <= r.start_line and r.parent_end_line >= r.end_line
        alone = (r.parent_start_line, r.parent_end_line) == (r.start_line, r.end_line)
        assert alone or chunk.words("\n".join(lines[r.parent_start_line - 1 : r.parent_end_line])) <= 150
        assert r.token_count == chunk.words(r.embed_text)
    covered = {w for r in got for w in r.text.split()}
    assert covered == set(source.split())


def test_scopes_and_parents(spark):
    source = module(60)
    df = spark.createDataFrame([("r", "a.py", "sha", source), ("r", "blank.py", "s2", " \n ")], "repo string, path string, blob_sha string, text string")
    got = chunk.chunk_documents(readers.read_documents(df), SMALL).collect()
    assert got and all(r.path == "a.py" and r.scope and r.scope.startswith("def f") and f"Scope: {r.scope}" in r.embed_text for r in got)
    assert all((r.parent_start_line - 1) % 5 == 0 for r in got)


def test_redaction_of_each_kind_in_one_text():
    """Every kind once, each on a line of its own, and what only looks like one; the expected text is put together from parts."""
    lines, expected = [], []
    for kind, secret in SECRETS.items():
        lines.append(f"a {secret} b")
        expected.append(f"a [REDACTED:{kind}]" + "\n" * secret.count("\n") + " b")
    for before, value, after, tag in [
        ("postgres+x://me:", "q7WazR5tUeP", "@db.local/x", "password"), ("api_key = '", "9fK2mQ7xLw", "'", "secret"), ('{"Auth-Key" : "', "9fK2mQ7xLw", '"}', "secret"),
        ("mail ", "jo.e+x@mail.corp.org", ", thanks", "email"), ("<", "a@b-c.de", "-x>", "email"),
    ]:
        lines.append(before + value + after)
        expected.append(f"{before}[REDACTED:{tag}]{after}")
    kept = ["http://me:changeme-please@h/x", "token = 'xxxxxxxxxxxx'", "tok = '9fK2mQ7xLw'", "secret = '9fK2mQ 7xLw'", "git@host.org:a/b", "a@mail3.example.com", "x/a@b.org", "a@b", "a@b.c1", "POSTGRES://me:q7WazR5tUeP@h"]
    text, found = redaction.redacted("\n".join(lines + kept))
    assert text == "\n".join(expected + kept)
    assert found == {**dict.fromkeys(SECRETS, 1), "connection_string_password": 1, "credential_assignment": 2, "email": 2}
