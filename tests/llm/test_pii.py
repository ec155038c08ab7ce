import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgrid.llm import pii as P

FIND = P.Finder()


def kinds(t):
    return [(k, t[a:b]) for a, b, k in FIND(t)]


def test_addresses():
    assert kinds("write to a.b+c@mail.example.com, please") == [("email", "a.b+c@mail.example.com")]
    assert kinds("<é.4@x1.example.org>.") == [("email", "é.4@x1.example.org")]
    assert kinds("a@b @c.de me@localhost x..y@z.com a@-b.com .@z.com") == []
    assert kinds("at 10.0.0.255. and 256.1.1.1, 1.2.3, 1.2.3.4.5") == [("ip", "10.0.0.255")]
    assert kinds("ftp://u:p@h.com/x https://a.b/c https://a.b/c?x=1&token=abcdefgh1234") == [("url", "ftp://u:p@h.com"), ("url", "https://a.b/c?x=1&token=abcdefgh1234")]


def test_long_urls_are_read_to_their_end():
    for n in (4060, 4075, 4100, 50_000):
        x = f"https://a.b/{'c' * n}?x=1&sig=abcdefgh1234&y={'d' * 5000}"
        assert kinds(f"see {x} there") == [("url", x)]
    assert kinds("http://a.b/" * 20_000) == []
    assert kinds("http://a.b/http://u:p@h.com/x") == [("url", "http://u:p@h.com")]


def test_accounts():
    assert kinds("4111 1111 1111 1111 4111111111111111 4111-1111-1111-1112") == [("account", "4111 1111 1111 1111"), ("account", "4111111111111111")]
    assert kinds("number 9807915762804490") == []  # fails its check digit
    assert kinds("GB82 WEST 1234 5698 7654 32 GB83WEST12345698765432") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("078-05-1120 000-05-1120 987-65-4321") == [("ssn", "078-05-1120")]
    assert kinds("+1 (017) 555-7713, (212) 555-1234; 212-555-1234") == [("phone", "+1 (017) 555-7713"), ("phone", "(212) 555-1234"), ("phone", "212-555-1234")]
    assert kinds("+1 (826) 555-4081 190.137.223.204") == [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204")]


def test_numbers_behind_signs():
    for sign in "+(":
        for kind, x in (("account", "4111 1111 1111 1111"), ("account", "4111111111111111"), ("ssn", "078-05-1120"), ("phone", "415-555-2671")):
            want = ("phone", sign + x) if sign == "+" and kind != "account" else (kind, x)  # with a plus, both are phone numbers
            assert kinds(f"at {sign}{x}) and on") == [want], (sign, x)
    assert kinds("(4111 1111 1111 1112) (2) +1 (826) 555-4081") == [("phone", "+1 (826) 555-4081")]


def test_secrets():
    assert kinds('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" TOKEN = "04DBEBAB91AB85687D33EEAA"') == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"), ("secret", "04DBEBAB91AB85687D33EEAA")]
    assert kinds("a token of thanks, the secretariat, password: short1") == []


def test_cues_are_whole_identifiers():
    x = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    for cue in ("key", "secret_key", "apiKey", "Api_Key", "accessToken", "authToken", "APIKey", "aws_secret_access_key", "X-Api-Key", "DB_PASSWORD_2", "iban", "mytoken", "tokens"):
        for behind in (f' = "{x}"', f"={x}", f": '{x}'", f'": "{x}"'):
            assert kinds(f"\u0130 {cue}{behind};") == [("secret", x)], (cue, behind)
    for cue in ("monkey", "keyboard", "secretariat", "tokenizer", "turkey", "hash"):
        assert kinds(f'{cue} = "{x}"') == []
    assert kinds("IBAN: GB82WEST12345698765432") == [("iban", "GB82WEST12345698765432")]


def test_cues_of_numbers():
    assert kinds("account number 12345678, Acct: 0012-3456-78; account no. 99887766") == [("account", "12345678"), ("account", "0012-3456-78"), ("account", "99887766")]
    assert kinds("passport C01234567 routing number 021000021 SSN 078051120 social security number: 078-05-1120") == [("passport", "C01234567"), ("routing", "021000021"), ("ssn", "078051120"), ("ssn", "078-05-1120")]
    assert kinds("routing 021000022, on account of 1999, accounts receivable 123456, passports in 2024, ssn 000112222, bank account: GB82 WEST 1234 5698 7654 32") == [("iban", "GB82 WEST 1234 5698 7654 32")]


def test_ipv6():
    assert kinds("at 2001:db8::1. and fe80::1%eth0 2001:0DB8:85a3:0000:0000:8a2e:0370:7334, fd12:3456::7") == [("ip", "2001:db8::1"), ("ip", "fe80::1"), ("ip", "2001:0DB8:85a3:0000:0000:8a2e:0370:7334"), ("ip", "fd12:3456::7")]
    assert kinds("10:30:45 a::b std::map ::1 12::30 2001:db8::1:2:3:4:5:6:7:8 x2001:db8::1") == []


def test_over_long_addresses_are_masked_whole():
    for n in (64, 65, 300, 5000):
        assert kinds(f"to {'x' * n}@mail.example.com.") == [("email", f"{'x' * n}@mail.example.com")]
    assert kinds(f"{'s' * 40}://u:p@h.com") == [("url", f"{'s' * 40}://u:p@h.com")]


@pytest.mark.parametrize("piece", ["2001:", "f:f", "aa:", "token=", "token ", "a@", "account 1 ", "4 ", "2001::", "key=1", "://", "@a."])
def test_time_in_proportion(piece):
    """Twice the text takes about twice the time, whatever it holds."""

    def took(n):
        began = time.perf_counter()
        FIND(piece * (n // len(piece)))
        return time.perf_counter() - began

    assert took(1 << 16) < 3 * took(1 << 15) + 0.1


def everywhere(t):
    """Spans found by trying every parser at every place of the text, with no anchors; each is checked to be of the leftmost place that has one."""
    out = set()
    for i in range(len(t)):
        if t[i] == "@":
            out.add(P.email(t, i))
        if t.startswith("://", i):
            out.add(P.url(t, i, 0)[0])
        if t[i] in P.DIGITS:
            out |= {P.iban(t, i), P.ip(t, i), P.digits(t, i) if i == 0 or t[i - 1] not in P.DIGITS else None}
        if t[i] in "+(":
            out.add(P.phone(t, i))
        out.add(P.ipv6(t, i))
        for c in P.CUES:
            if t[i:].lower().startswith(c):
                out.add(P.secret(t, *P.identifier(t, i))[0])
        for c, k in P.NAMED.items():
            if t[i : i + len(c)].lower() == c:
                out.add(P.named(t, i, i + len(c), k))
    return out - {None}


def test_anchors_find_all_that_parsers_find_everywhere(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text]
    x = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    docs += [f'apiKey = "{x}", account no. 12345678; ssn 078-05-1120', f"https://u:p@h.com/?token={x} at 2001:db8::1 GB82WEST12345698765432 (4111 1111 1111 1111)"]
    seen = set()
    for t in sorted(docs, key=len):
        got, every = FIND(t), everywhere(t)
        assert set(got) <= every, (t, got)
        for x in every:  # what isn't reported overlaps what is
            assert any(a < x[1] and x[0] < b for a, b, _ in got), (t, x, got)
        seen |= {k for _, _, k in got}
    assert seen >= {"email", "ip", "phone", "account", "secret"}


def test_clean_prose():
    assert kinds("In 1999, 4.0 of 100 (2) pages; see section 12.3 and 2024-01-31, 10:30, GPL version 3.0.1 + 2.") == []


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["a@b.co", " ", "@", "+1 ", "4111111111111111", "1.2.3.4", "(", "12", "-", ".", "token=", "x" * 17 + "1", "é", "://", "GB82", "\n"]), max_size=25).map("".join))
def test_spans_are_ordered_and_masking_agrees(t):
    spans = FIND(t)
    assert all(0 <= a < b <= len(t) for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    want, at = "", 0
    for a, b, k in spans:
        want, at = want + t[at:a] + f"<{k.upper()}>", b
    assert P.mask(t, FIND) == want + t[at:]


def brute(t):
    """E-mail addresses and network addresses by plain expressions over the whole text."""
    mails = [m.span() for m in re.finditer(r"(?<![\w.%+-])\w[\w.%+-]*@(?:[a-z0-9]+\.)+[a-z]{2,}", t)]
    ips = [m.span() for m in re.finditer(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w])(?!\.\d)", t) if all(int(x) < 256 for x in m.group().split("."))]
    return set(mails) | set(ips)


def test_same_as_expressions_on_the_tables(spark):
    rows = P.query(spark, "/root/testdata/sf0.001").filter("kind in ('email', 'ip')").collect()
    want = {(r.doc_id, *s) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() for s in brute(r.text)}
    assert {(r.doc_id, r.start, r.end) for r in rows} == want and want


def test_awkward(awkward, nothing, spark):
    assert P.find(awkward).count() == 0 and P.find(nothing).count() == 0
    out = P.redact(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert {r.doc_id: r.n_chars for r in out.filter("doc_id in (3, 4, 8)").collect()} == {3: None, 4: 0, 8: 3}
    docs = spark.createDataFrame([(None, "a@b.com"), (1, "x " * 200_000 + "a@b.com"), (1, "x " * 200_000 + "a@b.com"), (2, None)], "doc_id long, text string")
    assert [r.start for r in P.find(docs).filter("doc_id = 1").collect()] == [400_000] * 2
    assert P.find(docs).filter("doc_id is null").count() == 1
    assert P.redact(docs).filter("text = '<EMAIL>'").count() == 1
