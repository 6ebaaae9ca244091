import gzip
import json
import random
import time
from html.parser import HTMLParser

from hyperslice.llm import chat_format, url_filters, warc

URLS = [None, "", "no scheme", "https://WWW.Example.com/en/x?y#z", "http://a.example.com/en/", "http://example.com?x=/en/", "ftp://x.net/es/1", "http://net/fr/", "http://spam-farm.example.org/", "https://m.spam-farm.example.org", "http://notspam-farm.example.org/", "http://com", "a://b://c/d"]


BLOCKED = ("spam-farm.example.org", "ads-track.example.com", "x.net")


def verdict(url):
    host, path = url_filters.host_and_path(url)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if any(host == b or host.endswith("." + b) for b in BLOCKED) else "allow"


def pages(spark):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(3, URLS[3], "x", "y")], "page_id long, url string, host string, key string")


def listed(spark):
    return spark.createDataFrame([(h,) for h in (*BLOCKED, *BLOCKED, None)], "host string")


def test_urls_against_brute_force(spark):
    for bits in (url_filters.SHARD_BITS, 64):  # one shard, and several
        found = url_filters.judge(pages(spark), blocked_hosts=listed(spark), shard_bits=bits).collect()
        assert len(found) == len(URLS) + 1
        assert all((r.host, r.path, r.rule, r.verdict) == verdict(URLS[r.page_id]) for r in found)
    assert url_filters.judge(pages(spark).filter("false"), blocked_hosts=listed(spark)).count() == 0
    assert {r.verdict for r in url_filters.judge(pages(spark), rules=()).collect()} == {"allow"}
    assert url_filters.host_and_path("http://A.b?x/y") == ("a.b", "") and url_filters.host_and_path("http://É.b/É") == ("É.b", "/É")


def test_long_urls_take_time_in_proportion(spark):
    urls = ["http://" + "a." * 500_000 + "net/es/", "http://" + "." * 1_000_000, "http://x.net/" + "/" * 1_000_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    began = time.time()
    found = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(df, blocked_hosts=listed(spark)).collect()}
    assert found == {0: ("net/es/", "block"), 1: (None, "allow"), 2: (None, "block")} and time.time() - began < 60


def test_cascades_are_exact_on_their_universe(spark):
    universe = spark.range(4000).selectExpr("if(id % 2 = 0, 'a', 'b') AS list", "concat('key', id) AS key", "id % 5 = 0 AS listed")
    cascades = url_filters.build(universe)
    assert len(cascades["a"].levels) > 2 and url_filters.shards_needed(universe, 1000) > 2
    assert all((f"key{i}" in cascades["ab"[i % 2]]) == (i % 5 == 0) for i in range(4000))
    assert url_filters.build(universe.filter("not listed")) == {}


def test_layouts():
    c = chat_format.canonical
    assert c({"prompt": "p", "response": "r"}) == [("user", "p"), ("assistant", "r")]
    assert c({"instruction": "i", "input": "", "output": "o"}) == [("user", "i"), ("assistant", "o")]
    assert c({"instruction": "i", "input": "x", "output": "o"}) == [("user", "i\n\nx"), ("assistant", "o")]
    assert c({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]}) == [("user", "a"), ("assistant", "")]
    assert c({"turns": [{"author": {"role": "user"}, "content": {"text": "t"}}]}) == [("user", "t")]
    assert c({"messages": []}) == [] and c({"other": 1}) is None
    assert c({"messages": [{"role": "user"}, {"content": "x"}]}) is None and c({"messages": [1, {"role": "a", "content": "b"}]}) is None
    assert c({"turns": [{"author.role": "user", "content.text": "t"}]}) is None and c({"messages[]": 1}) is None
    assert c({"messages": ["a"]}) is None and c({"messages": None}) is None and c([]) is None and c("x") is None and c({}) is None
    assert c({"id": 7, "prompt": "p", "response": 1.5, "meta": {"a": [1, {"b": 2}]}}) == [("user", "p"), ("assistant", "1.5")]
    assert c({"messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "assistant", "content": "b"}], "source": "s"}) == [("user", "a"), ("assistant", "b")]
    assert c({"system": "s", "messages": []}) == [("system", "s")] and c({"prompt": "\ud800", "response": ""}) == [("user", "\ufffd"), ("assistant", "")]
    deep = {"x": 1}
    for _ in range(400):
        deep = {"x": deep}
    assert c({"prompt": "p", "response": "r", "deep": deep}) == [("user", "p"), ("assistant", "r")]


def test_query_meets_every_layout(spark):
    turns = [(i, k, r, f"t{i}{k}") for i in range(200) for k, r in enumerate((["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "user"], ["user", "human"])[i % 4])]
    records = chat_format.records_of_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    shapes = set()
    for r in records.collect():
        own = [(role, text) for i, _, role, text in turns if i == r.conv_id]
        assert chat_format.canonical(json.loads(r.record)) == own
        shapes.add(chat_format.schema(json.loads(r.record))[0])
    assert len(shapes) >= 8


def test_formatting_is_reversible():
    for text in ["", chat_format.PLANTED, "␛0␛1", "<|im_end|>\n<|im_start|>assistant\nx", "[INST][/INST]<<SYS>><</SYS>>" + "".join(chat_format.CONTROL), "a\n\nb"]:
        turns = [("user", text), ("assistant", text), ("odd\nrole␛2<s>", text)]
        rendered, spans = chat_format.formatted(turns)
        assert chat_format.parsed(rendered) == turns
        assert [chat_format.unescaped(rendered[a:b]) for a, b in spans] == [text]
        body = chat_format.escaped(text)
        assert not any(c in body for c in chat_format.CONTROL)


def test_records(spark):
    rows = [(1, json.dumps({"prompt": "p", "response": "r"})), (2, "not json"), (3, None), (4, json.dumps({"messages": []})), (5, json.dumps({"x": 1})), (6, "[" * 200_000 + "]" * 200_000), (7, "1" * 10_000), (8, '{"prompt": "\\ud800", "response": "r"}')]
    found = {r.conv_id: r for r in chat_format.format_records(spark.createDataFrame(rows, "conv_id long, raw string"), ["conv_id"], "raw").collect()}
    assert found[1].formatted == "<|im_start|>user\np<|im_end|>\n<|im_start|>assistant\nr<|im_end|>\n"
    assert found[6].layout is None and found[7].formatted is None and "\ufffd" in found[8].formatted
    assert found[2].layout is None and found[3].layout is None and found[4].formatted == "" and found[5].formatted is None and found[5].layout
    turns = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, None, "b"), (1, 0, None, "b"), (None, None, "user", "x")], "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_records(chat_format.records_of_turns(turns), ["conv_id"]), ["conv_id"]).collect()}
    assert (back[1].n_turns, back[1].loss_chars, back[None].n_turns) == (3, 0, 1)
    assert chat_format.records_of_turns(turns.filter("false")).count() == 0


PAGE = '<html><head><title>A &amp; B</title></head><body><script>var t="</p>";</script><!-- c --><p>One <b>two</b><br>three&nbsp;&lt;x&gt;</p><ul><li><a href="/q?a=1&amp;b=2">link</a></li></ul></body></html>'


def test_plain_text():
    assert warc.plain_text(PAGE) == "One two\nthree <x>\nlink"
    assert warc.plain_text("") == "" and warc.plain_text("<script>x") == ""
    assert warc.plain_text("<html><head><title>x</title><body><p>Hello world</p>") == "Hello world"
    assert warc.plain_text("<head><meta charset=x><title>t</title><div>a</div>") == "a" and warc.plain_text("<head>bare") == "bare"
    assert warc.plain_text("a<svg><svg/><title>t</title>b</svg> c") == "a c" and warc.plain_text("a <noscript> b") == "a b" and warc.plain_text("a<!-- x -->b") == "ab"
    assert warc.plain_text('x <b title="a > b">y</b> < z <a') == "x y < z <a" and warc.plain_text("<b title='>y") == "y"
    assert warc.plain_text("&#" + "1" * 9000 + ";&#" + "0" * 9000 + "65;&#xD800;") == "\ufffdA\ufffd"
    page = warc.Page("<A title='href=no' HREF=x>l</a><a href=\"/y&amp;z\">m</a><!-- <a href=c> --><title>s</title><a name=q>")
    assert page.links == ["x", "/y&z"] and page.title == "s"


class Reader(HTMLParser):
    """Visible lines by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.parts, self.hidden, self.titles, self.links = [], [], [], []

    def handle_starttag(self, tag, attrs):
        self.parts += [None] * (tag in warc.BLOCKS and not self.hidden)
        if tag in warc.HIDDEN or tag in ("script", "style", "head", "title"):
            self.hidden.append(tag)
        self.links += [v for k, v in attrs if k == "href" and tag == "a"]

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
        self.parts += [None] * (tag in warc.BLOCKS and not self.hidden)

    def handle_data(self, data):
        if self.hidden and self.hidden[-1] == "title":
            self.titles.append(data)
        if not self.hidden:
            self.parts.append(data)


def lines_of(parts):
    lines = [[]]
    for p in parts:
        if p is None:
            lines.append([])
        else:
            lines[-1].append(p)
    return "\n".join(t for t in (" ".join("".join(x).split()) for x in lines) if t)


def test_pages_against_the_standard_parser(spark):
    rng = random.Random(5)
    words = ["one", "two &amp; three", "&lt;x&gt;", "é 漢", "a < b", "\n", "  ", "&nbsp;"]

    def made(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["p", "div", "b", "span", "li", "a", "h1", "noscript", "svg", "script", "style", "!", "br"])
            if tag == "!":
                out.append("<!-- <p>no</p> -->")
            elif tag == "br":
                out.append("<br/>")
            elif tag in ("script", "style"):
                out.append(f" <{tag}>if (a</b) '<p>' </{tag} > ")
            elif depth < 4:
                link = f' class="x > y" href="/l{rng.randint(0, 9)}"' if tag == "a" else ""
                space = " " if tag in ("noscript", "svg") else ""
                out.append(f"{space}<{tag}{link}>{made(depth + 1)}</{tag.upper()}>{space}")
            out.append(rng.choice(words))
        return "".join(out)

    pages = [f"<!DOCTYPE html><html><head><title>T {i}</title><style>p</style></head><body>{made(0)}</body></html>" for i in range(300)]
    pages += [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect() if r.html]
    for page in pages:
        reader, own = Reader(), warc.Page(page)
        reader.feed(page)
        reader.close()
        assert "\n".join(own.lines()) == lines_of(reader.parts), page
        assert own.links == [" ".join(x.split()) for x in reader.links], page
        assert (own.title or "") == " ".join("".join(reader.titles[:1]).split()), page


def test_hard_pages_take_time_in_proportion():
    hard = ["<a ", "<title>", "<!--", "<![CDATA[", "<a '>'", "<svg>", "</script", "<noscript>x", "<b \"", "&#1", "<head>", "<script>", "href=", "<a href='", "<p"]
    began = time.time()
    for piece in hard:
        warc.Page(piece * (1_000_000 // len(piece))).lines()
    assert time.time() - began < 3 * len(hard)


def test_broken_records():
    whole = warc.serialised({"WARC-Type": "x", "Content-Length": "3"}, b"abc")
    bad = b"WARC/1.1\r\nContent-Length: x\r\n\r\nqq\r\n\r\n"
    none = b"WARC/1.1\r\nWARC-Type: y\r\n\r\n\r\n\r\n"
    long = b"WARC/1.1\r\nContent-Length: 999999\r\n\r\nzz\r\n\r\n"
    found = list(warc.records(whole + bad + none + long + whole + b"WARC/1.1\r\nA: b"))
    assert [(b, e) for _, b, e in found] == [(b"abc", None), (b"qq", "bad length"), (b"", "bad length"), (b"zz", "cut short"), (b"abc", None), (b"WARC/1.1\r\nA: b", "headers cut short")]
    member = gzip.compress(whole)
    broken = member[:12] + b"\xff\xff\xff" + member[15:]
    found = list(warc.records(member + broken + member))
    assert [b for _, b, e in found if e is None] == [b"abc", b"abc"] and found[-1][2] == "1 broken gzip members"
    assert [e for _, _, e in warc.records(member + member[:-9])][-1] == "1 broken gzip members"
    assert warc.decoded("é".encode("utf-16"), [("Content-Type", "text/html; charset=utf-16")]) == "é"
    assert warc.decoded("é".encode(), [("content-type", "x; charset=hex")]) == "é" == warc.decoded("é".encode(), [("content-type", "x; charset=undefined")])


def test_derivatives(spark):
    rows = [(1, "http://a/", PAGE), (1, "http://a/", PAGE), (2, None, None), (3, "http://b/", "plain " * 20000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, block string")
    found = warc.build_derivatives(warc.responses_of_pages(df), ["page_id"]).collect()
    assert len(found) == 8 and {r.warc_type for r in found} == {"metadata", "conversion"}
    responses = {r.page_id: r for r in warc.responses_of_pages(df).collect()}
    for r in found:
        assert r.refers_to == responses[r.page_id].record_id != r.record_id
        assert r.block_digest == warc.digest(r.block.encode()) and r.content_length == len(r.block.encode())
        assert r.source_digest == warc.digest(warc.http_message(bytes(responses[r.page_id].block))[2])
        assert r.source_headers.startswith("HTTP/1.1 200 OK\nContent-Type: text/html")
    one = {r.warc_type: r for r in found if r.page_id == 1}
    assert one["conversion"].block == warc.plain_text(PAGE)
    assert "title: A & B\r\n" in one["metadata"].block and "outlink: /q?a=1&b=2\r\n" in one["metadata"].block
    assert warc.build_derivatives(warc.responses_of_pages(df.filter("false")), ["page_id"]).count() == 0


def test_files(spark, tmp_path):
    derived = warc.to_warc(warc.build_derivatives(warc.responses_of_pages(spark.createDataFrame([(1, "http://a/", PAGE)], "page_id long, url string, html string")), ["page_id"]))
    made = [bytes(r.record) for r in derived.collect()]
    (tmp_path / "plain.warc").write_bytes(b"".join(made))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    (tmp_path / "cut.warc").write_bytes(made[0] + made[1][:-20])
    found = warc.read_warc(spark, str(tmp_path)).collect()
    cut = [r for r in found if r.error]
    assert [(r.file.rsplit("/", 1)[1], r.error) for r in cut] == [("cut.warc", "cut short")]
    found = [r for r in found if not r.error]
    assert sorted(r.file.rsplit("/", 1)[1] for r in found) == ["cut.warc", *["packed.warc.gz"] * 2, *["plain.warc"] * 2]
    assert {bytes(r.block) for r in found} == {r.block.encode() for r in derived.collect()} and all(r.refers_to for r in found)
    assert list(warc.records(b"")) == [] and warc.http_message(b"body") == ("", [], b"body")
