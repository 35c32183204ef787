import base64
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidewise.llm import secret_scan as ss

KEY = "AKIA" + "ABCDEFGH12345678"
TEXTS = [
    None, "", "nothing here", 'password = "abcdefgh1"', "PassWord:short", f"id {KEY} x", "AKIASHORT", "f" * 31 + " " + "0123456789abcdef" * 2 + "Z", f"token={'a1b2c3d4' * 5}", "secret=abc=def==gh token:12345678",
    "pwd: q9$Lx!7vTz2# end", "pwd: password123 end", "é" * 5 + " api_key='ABCDEFGH'", "token" + " " * 50_000 + "= x", "ſecret=abcdefgh", "x" * 200_000 + " apikey=zyxwvuts",
]


def brute(text):
    """Every pattern on its own, by the letter of the task."""
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_report_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("n_hex", F.lit(7))
    rows = {r["doc_id"]: r for r in ss.secret_report(df).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want, r = brute(text), rows[i]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[0] == k for x in want) for k in ("assign", "access", "hex")]
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))
    assert rows[10]["n_guess"] == 1 and rows[11]["n_guess"] == 0


def brute_cost(value):
    """All segmentations, no sharing between them."""
    each, found = ss._classes(value), ss._segments(value)

    def best(i, first, brute):
        if i == len(value):
            return 0.0
        out = each + (0 if brute or first else ss.JOIN) + best(i + 1, False, True)
        for j, c in found[i]:
            out = min(out, c + (0 if first else ss.JOIN) + best(j, False, False))
        return out

    return best(0, True, False)


@pytest.mark.parametrize("value", ["", "a", "password", "P4ssw0rd!", "qwerty2019-05-06", "aaaabbbb", "x7#kQ", "letmein123", "zxcvqq19990101"])
def test_dynamic_programme_is_the_least_cost(value):
    assert ss.guesses_log10(value) == pytest.approx(brute_cost(value))


def test_order_of_costs():
    weak, strong = ["password123", "qwertyuiop", "aaaaaaaaaa", "2019-05-06", "letmein"], ["q9$Lx!7vTz2#", "8fK2jd93Lm5x", "Zx81-pQ7wv_2"]
    assert max(map(ss.guesses_log10, weak)) < ss.HARD < min(map(ss.guesses_log10, strong))


def test_redaction_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in ss.redact_secrets(df).collect()}
    assert len(out) == len(TEXTS)
    assert out[5]["text"] == "id [SECRET] x" and out[5]["n_chars"] == 13
    assert out[2]["text"] == TEXTS[2] and out[0]["text"] is None
    assert not any(brute(r["text"]) for r in out.values())


def test_empty_table(spark):
    assert ss.secret_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prose_after_a_name_is_no_secret(spark):
    prose = ["the password is required here", "your token is invalid, try again", "this secret is forgotten by everyone", "a compass is pointing north"]
    rest = [f"it was required {i}, invalid and (forgotten) by everyone pointing at xqjvwkzhg" for i in range(4)]
    secrets = ["the password is q9Lx7vTz2wP4 now", "userPassword: hT7qzRw92LmX", "db_password: hT7qzRw92LmX"] + ["secret is wjqxkvbzpfhg"] * 5
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(prose + rest + secrets)], "doc_id long, text string, n_chars long")
    rows = {r["doc_id"]: r["spans"] for r in ss.secret_report(df).collect()}
    assert [rows[i] for i in range(8)] == [""] * 8
    assert all("guess" in rows[i] or "assign" in rows[i] for i in range(8, 16))
    kept = {r["doc_id"]: r["text"] for r in ss.redact_secrets(df).collect()}
    assert [kept[i] for i in range(8)] == prose + rest and all("[SECRET]" in kept[i] for i in range(8, 16))
    assert not ss.find_secrets("a compass is " + "q9Lx7vTz2wP4")


def test_ranks_of_words(tmp_path):
    ranks = ss.word_ranks()
    assert list(ranks.values()) == list(range(1, len(ranks) + 1)) and [*ranks][:3] == ss.WORDS[:3]
    assert {"required", "forgotten", "invalid", "between"} <= set(ranks)
    own = tmp_path / "ranks"
    own.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate([b" Zebra", b"piece", b" ab", b" x1y", b" apple"])))
    assert [*ss.word_ranks(str(own))][len(dict.fromkeys(ss.WORDS)) :] == ["zebra", "apple"]


def test_a_text_is_judged_by_itself(spark):
    prose = ["the token is required to enter", "your password is incorrect"]
    for rows in (prose, [*prose, *prose, "other"] * 9):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
        assert all(r["spans"] == "" for r in ss.secret_report(df).collect())


def test_every_value_has_its_cost(spark):
    texts = ['password = "x9Kq7Lm2Wd4R"', "token: summer2019", "password=hunter2hunter2 and token=8fK2jd93Lm5x", "nothing", None, "xtoken=8fK2jd93Lm5x"]
    rows = {r["doc_id"]: r for r in ss.secret_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i]["n_values"] for i in range(6)] == [1, 1, 2, 0, 0, 1]
    assert [rows[i]["n_guess"] for i in range(6)] == [1, 0, 2 - (ss.guesses_log10("hunter2hunter2") < ss.HARD), 0, 0, 1]
    assert rows[0]["hardest_log10"] == pytest.approx(ss.guesses_log10("x9Kq7Lm2Wd4R")) and rows[3]["hardest_log10"] is None
    assert rows[2]["easiest_log10"] == pytest.approx(min(ss.guesses_log10("hunter2hunter2"), ss.guesses_log10("8fK2jd93Lm5x")))
    assert rows[0]["spans"] == "assign:0:24,guess:12:24"


@pytest.mark.parametrize("text", [
    '{"api_key": "VALUE"}', "postgres://app:VALUE@db.example.org/main", "Authorization: Bearer VALUE", "Authorization: Basic VALUE", "run --password VALUE --now", "run -token VALUE", "export DB_PASSWORD=VALUE",
])
def test_contexts(text):
    value = "q9Lx7vTz2wP4"
    found = ss.find_secrets(text.replace("VALUE", value))
    assert ("guess", text.index("VALUE"), text.index("VALUE") + len(value)) in [f[:3] for f in found]
    assert not [f for f in ss.find_secrets(text.replace("VALUE", "required")) if f[0] == "guess"]


def test_blanks_of_any_kind_and_number():
    value = "X9fk2LmQ7ZpT"
    for between in ("\tis\t", " " * 40 + "= ", "\t:\t", " is "):
        text = f"the token{between}{value} ends"
        assert any(text[a:b].endswith(value) for _, a, b, _ in ss.find_secrets(text)), repr(between)
    assert not ss.find_secrets("a keyword is here, and a passing bus is late")


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "password: hunter2hunter2"), (1, "password: hunter2hunter2"), (None, None)], "doc_id long, text string")
    rows = ss.secret_report(df).collect()
    assert len(rows) == 3 and sorted(r["n_assign"] for r in rows) == [0, 1, 1]
