import pickle
import random
import re

from webstrata.functions import literals
from webstrata.operators import extract, secrets, tech
from webstrata.sources import rules as R


def test_patterns_and_versions():
    assert R.Pattern.of(r"^made/(\d\S*)\;version:\1").match("Made/1.2") == (True, "1.2")
    assert R.Pattern.of("").match("any") == (True, None) and R.Pattern.of("a.b").match("axb") == (False, None)
    assert R.Pattern.of(r"x([a\;version:\1").match("x([a") == (True, None)
    m = re.search(r"v(\d)(\d)?", "v1")
    assert R.rendered(r"\1?one:none", m) == "one" and R.rendered(r"\3?a:b", m) == "b" and R.rendered(r"\1.\2", m) == "1."


def test_implies_is_closed_and_bounded():
    rules = R.technologies({"a": {"implies": "b"}, "b": {"implies": [r"c\;confidence:50\;version:3", "unknown"]}, "c": {"implies": "a"}})
    assert R.implied(rules) == {"a": {"b": None, "c": "3"}, "b": {"a": None, "c": "3"}, "c": {"a": None, "b": None}}
    assert list(R.implied(rules, rounds=1)["a"]) == ["b"]


def test_required_literals():
    for expression, want in (("^sampled/(\\d+)", "sampled/"), ("a?bcd", "bcd"), ("abc*de", "ab"), ("Foo|bar", ""), ("x(?:one|two)yyy", "yyy"), (r"cart\.js", "cart.js"), (r"\bword\d+tail", "word"), ("[abc]{2}", ""), ("ab{2}cd", "cd")):
        assert R.required(expression) == want, expression
    for raw, text in ((r"ab{0}cd+", "acd"), (r"É+x", "éx"), (r"a+b", "aab")):
        assert R.Pattern.of(raw).match(text)[0]


def test_packs_from_files_and_urls(tmp_path):
    (tmp_path / "a.json").write_text('{"technologies": {"X": {"cats": [1], "html": "x-mark"}}}')
    (tmp_path / "categories.json").write_text('{"1": {"name": "Things"}}')
    for path, categories in ((str(tmp_path), None), (str(tmp_path / "a.json"), str(tmp_path / "categories.json")), ((tmp_path / "a.json").as_uri(), (tmp_path / "categories.json").as_uri())):
        [t] = R.read_technologies(path, categories)
        assert (t.name, t.category) == ("X", "Things") and t.lists["html"][0].match("an X-Mark") == (True, None)


def test_detection(spark):
    html = '<meta property="generator" content="Sample CMS v9"><meta name="generator" content="Sample CMS v6.1"><script src="/sample-shop/cart.js?v=7.2"></script><script src="https://cdn1.example.net/widgets@3.6/all.js"></script>'
    schema = "page_id long, url string, html string, h map<string,string>, d map<string,string>, x array<string>"
    data = [(1, "https://e.com/", html, {"Server": "Sampled/1.25", "X": "y"}, None, None), (2, "https://e.com/", "", None, {"SPF": "v=spf1", "TXT": "Sample-Counter-Site=1"}, ['SampleWidgets.boot("2.0")']), (3, None, None, None, None, None)]
    rows = extract.parsed(spark.createDataFrame(data, schema))
    got = {(r.page_id, r.technology_name): (r.technology_version, r.is_implied, r.technology_category) for r in tech.technologies_of(rows, headers="h", dns="d", external="x").collect()}
    assert got == {
        (1, "Sample Server"): ("1.25", False, "Web servers"), (1, "Sample CMS"): ("6.1", False, "CMS"), (1, "Sample Shop"): ("7.2", False, "Ecommerce"), (1, "Sample Widgets"): ("3.6", False, "JavaScript libraries"),
        (1, "Sample Language"): ("8", True, "Programming languages"), (1, "Example CDN"): (None, False, "CDN"), (2, "Sample Counter"): (None, False, "Analytics"), (2, "Sample Widgets"): ("2.0", False, "JavaScript libraries"),
    }


def test_pattern_is_trimmed():
    assert R.Pattern.of(r"  name (\d)\;version:\1 ").match("name 4") == (True, "4")


def test_secrets_of_whole_answers(spark):
    """Headers, cookies and external scripts, once each, with the claims of tokens among them."""
    head = "eyJhbGciOiJIUzI1NiJ9"
    token = head + ".eyJpc3MiOiJtZSIsImV4cCI6MTB9.c2lnbmF0dXJlMTIz"
    key = "AK" + "IAQWERTZUIOPASDF23"
    rows = [(1, "<p>none</p>", {"X-Key": key, "Set-Cookie": "no"}, [f"sid={token}; Path=/"], {"https://a.com/x.js": f"k='{key}'"}), (2, f"<!-- {key} -->", {"X-Key": key}, None, None), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, html string, h map<string,string>, c array<string>, s map<string,string>")
    out = secrets.exposed_of_answers(df, "id", "html", "h", "c", "s")
    assert sorted((r.id, r.secret_type, r.location) for r in out.collect()) == [(1, "aws-access-key", "response_header"), (1, "jwt", "set_cookie"), (2, "aws-access-key", "html_comment")]
    assert [(r.id, r.issuer) for r in secrets.token_claims(out, "id").collect()] == [(1, "me")]


def fake(prefix, body):
    return prefix + body


def test_secrets(spark):
    key, header = fake("AKIA", "QWERTZUIOPASDF23"), "eyJhbGciOiJIUzI1NiJ9"
    jwt = fake(header, ".eyJpc3MiOiJtZSIsImV4cCI6MTB9.c2lnbmF0dXJlMTIz")
    page = f'<!-- {key} --><script>var t = "{jwt}&"; csrf_token = "abcdef0123456789ghij"</script><div data-k="{key}">'
    found = secrets.scan(page, R.secret_rules())
    assert [(f["secret_type"], f["location"]) for f in found] == [("aws-access-key", "html_comment"), ("jwt", "inline_script")]
    rows = spark.createDataFrame([(1, page), (2, "nothing"), (3, None)], "id long, t string")
    out = secrets.exposed(rows, "id", "t")
    assert out.count() == 2
    claims = secrets.token_claims(out, "id").collect()
    assert [(c.id, c.issuer, c.expiration_ms) for c in claims] == [(1, "me", 10_000)]


def test_overrides_and_dialect():
    base = "[[rules]]\nid='a'\nregex='''(x+)%s'''\n[[rules]]\nid='b'\nregex='''k(?i)[[:alnum:]]+\\z'''\n[[rules]]\nid='c'\nregex='''('''\n" % R.STRICT_END
    pack = R.secret_rules(base, "[[rules]]\nid='n'\nregex='''(y)'''\n[[append]]\nid='a'\n[[append.allowlists]]\nstopwords=['xxx']\n")
    assert [r.id for r in pack.rules] == ["a", "b", "n"] and pack.dropped == ["c"]
    assert [f["matched_value"] for f in secrets.scan("xx& xxxx;", pack)] == ["xx"] and secrets.scan("kAB", pack)[0]["matched_value"] == "kAB"


def slow_scan(text, pack):
    """Every rule by itself."""
    low, out = text.lower(), []
    for r in pack.rules:
        if not r.keywords or any(k in low for k in r.keywords):
            out += [(r.id, secrets.secret_of(r, m)) for m in r.regex.finditer(text)]
    return out


def big_pack(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 5)))
    rules = []
    for i in range(n):
        key, other = word(), word()
        body = rng.choice([f"{key}_([0-9]{{2,4}})", f"(?i)(?:{key}|{other})[-_]([0-9a-f]{{3}})", f"[)]{key}(x)?", f"{key}[{other}]+=[0-9]"])
        keys = rng.choice([[key], [key, other], [], [key.upper()]])
        rules.append(f"[[rules]]\nid = 'r{i}'\nregex = '''{body}'''\nkeywords = {keys}\n")
    return R.secret_rules("".join(rules))


def test_many_rules_at_once():
    """The automaton lets exactly those rules run that could find something, on a pack of 225 rules."""
    pack, rng = big_pack(225), random.Random(2)
    assert len(pack.rules) == 225
    keys = sorted({k for r in pack.rules for k in r.keywords})
    hits = 0
    for _ in range(60):
        text = " ".join(rng.choice([rng.choice(keys) + rng.choice("_-=") + str(rng.randint(1, 99999)), ")" + rng.choice(keys).upper() + "x", "plain", "abc def"]) for _ in range(40))
        got = [(f["secret_type"], f["matched_value"]) for f in secrets.scan(text, pack)]
        assert set(got) == set(slow_scan(text, pack)) and len(got) == len(set(got))
        hits += len(got)
    assert hits > 150


def test_cost_does_not_grow_with_rules(monkeypatch):
    """A text that no rule fits is read once and starts no expression, whatever the number of rules."""
    text = "nothing of note " * 1000
    for n in (10, 1000):
        pack = R.secret_rules("".join(f"[[rules]]\nid = 'r{i}'\nregex = '''key{i}_[0-9]+'''\nkeywords = ['key{i}_']\n" for i in range(n)))
        assert pack.running(text) == [] and [r.id for r in pack.running(text + "KEY7_1")] == ["r7"]
        calls = []
        monkeypatch.setattr(literals.Literals, "found", lambda self, t, calls=calls: calls.append(len(t)) or set())
        assert secrets.scan(text, pack) == [] and calls == [len(text)]
        monkeypatch.undo()


def test_literals():
    rng = random.Random(3)
    for _ in range(50):
        words = {"".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(12)}
        own, text = literals.Literals(words), "".join(rng.choices("abc", k=60))
        own = pickle.loads(pickle.dumps(own))
        assert {own.words[i] for i in own.found(text)} == {w for w in words if w in text}
    assert literals.Literals([]).found("x") == set() and literals.folded("K\u0130\u0131\u017f\u212a") == "kiisk"
    p = R.Pattern.of("skip")
    assert p.match("\u017f\u212aip")[0] and literals.Gate([([], p.literal)]).open("a \u017f\u212aip") == [0]


def test_gated_detection_is_that_of_every_rule():
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "x-y"]
    pack = {f"t{i}": {rng.choice(["html", "scripts", "scriptSrc", "url"]): [rng.choice([rng.choice(words), rf"{rng.choice(words)}/(\d+)\;version:\1", r"^\d+$", "", rf"[)]?{rng.choice(words)}"]) for _ in range(2)], "headers": {rng.choice(["a", "b", "c"]): rng.choice(["", r"(\d)\;version:\1"])}, "cookies": {rng.choice(["s_*", "sid", "*"]): ""}} for i in range(120)}
    rules = R.technologies(pack)
    matcher = tech.Matcher(rules)
    for _ in range(40):
        some = lambda: " ".join(rng.choice([*words, "alpha/3", ")beta", "12", ""]) for _ in range(rng.randint(0, 4)))
        channels = [("headers", {k: [some()] for k in rng.sample("abcd", 2)}), ("cookies", {k: [""] for k in rng.sample(["s_1", "sid", "other"], 1)}), ("html", [some()]), ("scriptSrc", [some(), some()]), ("scripts", [some()]), ("url", [some()]), ("scripts", [some()])]
        want = []
        for t in rules:
            version, rank = None, None
            for r, (channel, values) in enumerate(channels):
                if version:
                    break
                ok, v = tech.keyed_match(t.maps[channel], values) if channel in t.maps else tech.first_match((p, x) for p in t.lists.get(channel, []) for x in values)
                if ok:
                    version, rank = v, r if rank is None else rank
            if rank is not None:
                want.append({"technology_name": t.name, "technology_version": version, "rank": rank})
        assert matcher.detect(channels) == sorted(want, key=lambda x: [t.name for t in rules].index(x["technology_name"]))


def test_whole_lines_and_keys_of_a_page():
    pad = " " * 5000
    pack = R.secret_rules("[[rules]]\nid='n'\nregex='''n([0-9]+)'''\nkeywords=['n']\n[[rules.allowlists]]\nregexTarget='line'\nregexes=['^skip', 'skip$']\n")
    text = f"skip{pad}n1{pad}n2\nkeep{pad}n3{pad}\n{pad}n4{pad}skip\nn5"
    assert [f["matched_value"] for f in secrets.scan(text, pack)] == ["3", "5"]
    key = lambda c: "-----BEGIN RSA PRIVATE" + f" KEY-----\n{c * 40}\n" + "-----END RSA PRIVATE KEY-----"
    assert len(secrets.scan(key("a") + "\n" + key("b"), R.secret_rules())) == 2


def test_rules_of_paths_are_left_out():
    pack = R.secret_rules("[[rules]]\nid='f'\nregex='''x'''\npath='''\\.tf$'''\n[[rules]]\nid='g'\nregex='''y'''\n")
    assert [r.id for r in pack.rules] == ["g"] and pack.of_paths == ["f"]
