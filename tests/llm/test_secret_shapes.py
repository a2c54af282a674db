"""Secrets that are no long runs with a digit, and the context of values."""

import re

import pytest

from graphloom.llm import secret_scan

BODY = "\n".join("MIIEpAIBAAKCAQEA" + "x1Yz" * 12 for _ in range(20)) + "\nQ2Fz="
PEM = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{BODY}\n-----END RSA PRIVATE KEY-----"


@pytest.fixture(scope="module")
def masked(spark):
    forest = secret_scan.fit(spark)

    def run(texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [r.text for r in sorted(secret_scan.mask_secrets(rows, forest).collect(), key=lambda r: r.doc_id)]

    return run


def test_short_passwords_and_whole_keys_are_masked(masked):
    cases = {
        'password = "Tr0ub4dor&3x!" and': 'password = "[SECRET]" and',
        'passphrase: "correct horse battery staple"': 'passphrase: "[SECRET]"',
        '{"password": "hunter", "x": "y"}': '{"password": "[SECRET]", "x": "y"}',
        "password=hunter22, then": "password=[SECRET], then",
        "db: postgres://user:p4ssw0rd@host/db": "db: postgres://user:[SECRET]@host/db",
        f"a {PEM} b": "a [SECRET] b",
        f"-----BEGIN PRIVATE KEY-----\n{BODY}\nthe end": "[SECRET]\nthe end",
    }
    assert masked(list(cases)) == list(cases.values())


def test_secrets_without_digits_and_short_ones(masked):
    cases = {
        'token = "qWzRtYpLkJhGfDsXcVbNm" x': 'token = "[SECRET]" x',
        "api_key: hGfDsApOiUyTrEwQzXcVbNmKj": "api_key: [SECRET]",
        "secret=zqxjkvbwpmfgdhtrnlcs": "secret=[SECRET]",
        "client_secret = 'a8Kd0sLq2Wx9'": "client_secret = '[SECRET]'",
    }
    assert masked(list(cases)) == list(cases.values())


def test_long_words_rules_and_numbers_stay(masked):
    plain = ["das Donaudampfschifffahrtsgesellschaft fuhr", "otorhinolaryngologically speaking", "-" * 60, "call 555-123-4567 or +44-20-7946-0958", "a state-of-the-art-method", "in src/main/resources/templates it is", "order 123456789012 was sent"]
    assert masked(plain) == plain


def test_very_long_candidates(spark):
    forest = secret_scan.fit(spark, trees=3)
    text = "x " + "aB3" * 300_000 + " y token = \"" + "k9" * 2000 + "\""
    got = secret_scan.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), forest).collect()
    assert sorted(r.n_chars for r in got) == [4000, 900_000]


def test_plain_values_stay(masked):
    plain = ["mailto:john@example.com", "the password: remember it", "password: changeme", "https://x.com:8080/ab/cd/ef/12345678901", "compass: northern"]
    assert masked(plain) == plain


def test_a_name_that_is_a_candidate_leaves_the_value_its_context(masked):
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzz7K"
    cases = {
        f"export S3_SECRET_ACCESS_KEY={key}": "export S3_SECRET_ACCESS_KEY=[SECRET]",
        f'AUTH0_CLIENT_SECRET = "{key}"': 'AUTH0_CLIENT_SECRET = "[SECRET]"',
        f'AUTH0_CLIENT_SECRET="{key}" x': 'AUTH0_CLIENT_SECRET="[SECRET]" x',
    }
    assert masked(list(cases)) == list(cases.values())


def test_context_is_read_from_the_whole_text(spark):
    texts = ["", "S3_SECRET_ACCESS_KEY=abcdefghijklmno7 x", "é🙂 " + 'password = "abcdefg" token: hijklm9 ' * 40, "x \uf8ff " + 'token: hijklm9 \uf8ff ' * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for i, found in rows.selectExpr("i", secret_scan.candidates("t") + " AS f").collect():
        want = [(m.group(), texts[i][max(0, m.start() - 48) : m.start()], texts[i][m.end() : m.end() + 48], m.start()) for m in re.finditer(secret_scan.CANDIDATE, texts[i])]
        assert [tuple(c) for c in found] == want and len(want) == (0, 2, 80, 3)[i]
