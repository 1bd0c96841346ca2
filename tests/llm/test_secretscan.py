import random
import re

from seamfinder.llm import secretscan as S


def slow(text):
    text = text or ""
    out = []
    pos = 0
    word = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    while m := word.search(text, pos):
        pos = m.end()
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base():
    r = random.Random(5)
    bits = ["password", "PassWD", "ſecret", "toKen", "secret", "Api_Key", "apikey", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGH12345678", "0f" * 9, "abc", "é", "\n", "x+/._-", "\U0001f600"]
    for _ in range(2000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(25)))
        assert S.base(t) == slow(t), t


def test_links():
    t = "login: maria\npw aB3dE5gH7jK9mN1pQ\n\n" + "word " * 90 + "zX9cV8bN7mA6sD5fG4 alone\n\nsee https://db.example.com/x for more"
    got = S.spell(S.linked(t, S.base(t)))
    assert got == f"identifier:0:12,token:16:33"
    u = "see https://db.example.com/x token = abcdef99"
    assert S.spell(S.base(u) + S.linked(u, S.base(u))) == "endpoint:4:28,assign:29:45"
    assert S.linked("login: maria is all there is", []) == []


def test_scan_and_redact(spark):
    rows = [(1, "x secret=abcdefg y"), (2, None), (3, ""), (None, "AKIA" + "Z" * 16), (1, "x secret=abcdefg y"), (4, "w " * 200000 + "token: 12345678")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as spans", "1 as id")
    got = sorted((x.id or 0, x.n_assign, x.n_access, x.n_hex, x.spans) for x in S.scan(df).collect())
    assert got == [(0, 0, 1, 0, "access:0:20"), (1, 1, 0, 0, "assign:2:16"), (1, 1, 0, 0, "assign:2:16"), (2, 0, 0, 0, ""), (3, 0, 0, 0, ""), (4, 1, 0, 0, "assign:400000:400015")]
    red = S.redact(df)
    assert red.columns == df.columns
    assert {x.text for x in red.where("doc_id <= 3 or doc_id is null").collect()} == {"x <SECRET> y", None, "", "<SECRET>"}
    assert S.scan(df.limit(0)).count() == S.redact(df.limit(0)).count() == 0


def test_parts_of_any_length_and_distance(spark):
    long = "aB3" * 100
    t = f"login: {'m' * 300}\n" + "word " * 500 + long + "\nsee https://db.example.com/" + "x" * 5000
    end = len(t)
    assert S.spell(S.linked(t, S.base(t))) == f"identifier:0:307,token:2808:3108,endpoint:3113:{end}"
    (red,) = S.redact(spark.createDataFrame([(1, t)], "doc_id long, text string")).collect()
    assert red.text == "<SECRET>\n" + "word " * 500 + "<SECRET>\nsee <SECRET>"
    assert S.linked(f"login: maria\n\n{long}", []) == []


def test_links_like_brute_force():
    """Every part against every other, paragraph by paragraph."""
    import random
    import re

    meet = lambda x, y: x[0] < y[1] and y[0] < x[1]
    r = random.Random(17)
    bits = ["login: maria", "user = bob99", "aB3dE5gH7jK9mN1pQ", "AKIA" + "Q7" * 8, "https://db.example.com/x", "password: hunter22", "plain words", "0123456789abcdef01234567", "\n\n", "\n \t\n", "\n", " ", "Zz9" * 9, "="]
    some = 0
    for _ in range(1500):
        text = " ".join(r.choice(bits) for _ in range(r.randrange(14)))
        known = S.base(text)
        taken = [(s, e) for s, _, e in known]
        clear = lambda xs, by: [x for x in xs if not any(meet(x, y) for y in by)]
        ids = clear([m.span() for m in S._IDENTIFIER.finditer(text)], taken)
        ends = clear([m.span() for m in S._ENDPOINT.finditer(text)], taken)
        tokens = [x for x in clear([m.span() for m in S._TOKEN.finditer(text)], taken + ids + ends) if S._mixed(text[slice(*x)])]
        breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
        edges = [0, *breaks, len(text)]

        def confirmed(xs, by):
            out = []
            for x in xs:
                i = sum(b <= x[0] for b in breaks)
                out += [x] if any(meet((edges[i], edges[i + 1]), y) for y in by) else []
            return out

        places, secrets = [(s, e) for s, k, e in known if k == 1] + ids + ends, [(s, e) for s, k, e in known if k != 1] + tokens
        want = sorted([(s, 3, e) for s, e in confirmed(ids, secrets)] + [(s, 4, e) for s, e in confirmed(tokens, places)] + [(s, 5, e) for s, e in confirmed(ends, secrets)])
        assert sorted(S.linked(text, known)) == want, text
        some += len(want)
    assert some > 500
