"""A small bilingual site, end to end, and units of the parts."""

import os
import random
import struct
from pathlib import Path

import pandas as pd
import pytest
from sitepair.cli import main
from sitepair.functions.html import parse, select, tidy, to_markdown
from sitepair.functions.identity import path_issue
from sitepair.functions.page import clean_title, media_relative, resolve, rewrite
from sitepair.functions.scalars import slug_date
from sitepair.operators import hreflang, pairing
from sitepair.plans.engine import SiteEngine
from sitepair.sources import files, frontmatter
from sitepair.sources.config import ConfigError, load

CONFIG = """
config_version: 1
site: {base_url: https://old.example.org}
url_pattern: {lang_map: {ch: zh-Hant, en: en}, default_lang: zh-Hant, strip_extensions: [.php]}
extract:
  content: "section[id]:not(#header):not(#footer)"
  title_noise: [Our Site]
  section_types: {news: article, events: event}
  section_flags: {support: needs_rebuild}
  type_rules:
    article: {title_selector: "#main h3", remove_selectors: ["#main h3"], images_to_gallery: true}
pairing: {fallback: [hreflang, slug_normalized, shared_media, date, title_similarity]}
"""


def _page(title, body, head=""):
    return f"<html><head><title>{title}</title>{head}</head><body><section id=header>NAV</section><section id=main>{body}</section></body></html>"


SITE = {
    "index.php.html": _page("Our Site", "<p>Choose</p>"),
    "ch/index.php.html": _page("Home", '<p>Home <a href="news/index.php">news</a></p>'),
    "en/index.php.html": _page("Home", '<p>Home <a href="https://other.example/x">x</a></p>'),
    "ch/news/20260214.php.html": _page("a", "<h3>Lanterns: a night</h3><p>Some longer text of an evening that is told here at a length beyond the bound of short pages.</p>"),
    "en/news/02142026.php.html": _page("b", '<h3>Parade</h3><p>Text <a href="../support/donate.php#x">give</a></p><a href="i.jpg"><img src="i.jpg" alt="one"></a><img src="gone.jpg">'),
    "ch/events/summer.php.html": _page("Camp", "<p>c</p>", '<link rel="alternate" hreflang="en" href="/en/events/enCamp.php">'),
    "en/events/enCamp.php.html": _page("2026/01/02 News: Camp", "<p>c</p>", '<link rel="alternate" hreflang="zh-Hant" href="/ch/events/summer.php">'),
    "en/support/donate.php.html": _page("Our Site - Donate", '<p>Give</p><iframe src="/files/a.pdf"></iframe><iframe src="https://www.youtube.com/embed/q"></iframe>'),
    "ch/con.php.html": _page("Bad", "<p>unsafe</p>"),
}


@pytest.fixture(scope="module")
def site(tmp_path_factory):
    root = tmp_path_factory.mktemp("site")
    for path, text in SITE.items():
        (root / "raw" / path).parent.mkdir(parents=True, exist_ok=True)
        (root / "raw" / path).write_text(text)
    (root / "media/en/news").mkdir(parents=True)
    (root / "media/en/news/i.jpg").write_bytes(b"not a picture")
    (root / "media/files").mkdir()
    (root / "media/files/a.pdf").write_bytes(b"not a document")
    return root


def test_extract_and_verify(spark, site):
    engine = SiteEngine(spark, load(CONFIG))
    report = engine.extract(f"{site}/raw", f"{site}/media", f"{site}/out")
    assert (report.pages, report.path_errors, report.missing_images, report.need_fetch) == (8, 1, 1, 1)
    assert (report.declared, report.usable, report.suggested_pairs, report.exit_code) == (2, 2, 2, 2)
    inventory = {r[0]: r for r in files.read_csv((site / "out/content_inventory.csv").read_text())[1:]}
    head = files.read_csv((site / "out/content_inventory.csv").read_text())[0]
    col = {k: i for i, k in enumerate(head)}
    assert inventory["events/summer"][col["suggested_pair"]] == "events/enCamp"
    assert inventory["events/summer"][col["pair_evidence"]].startswith("hreflang=zh-Hant;")
    assert inventory["news/20260214"][col["pair_evidence"]] == "date=2026-02-14"
    assert inventory["index"][col["pair_status"]] == "paired" and inventory["/index"][col["pair_status"]] == "site_level"
    assert inventory["support/donate"][col["flags"]] == "needs_rebuild"
    text = (site / "out/content/en/news/02142026.md").read_text()
    assert "title: Parade\n" in text and "slug: '02142026'" in text and "- local: /media/en/news/i.jpg\n  alt: one" in text and text.endswith("Text [give](/en/support/donate#x)\n")
    donate = (site / "out/content/en/support/donate.md").read_text()
    assert "title: Donate" in donate and '<iframe src="/media/files/a.pdf" title="PDF"' in donate and "- type: youtube\n  url: https://www.youtube.com/embed/q" in donate
    raw = (site / "out/redirect_map.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfold_url,") and raw.count(b"\r\n") == 9
    issues = {(r.kind, r.page) for r in engine.verify(f"{site}/out", f"{site}/media").collect()}
    assert ("unlinked_page", "ch/events/summer.md") in issues and not any(k in ("missing_media", "missing_field", "invalid_frontmatter") for k, _ in issues)
    assert engine.mirror_slugs(f"{site}/raw", "news") == ["02142026", "20260214"] and engine.mirror_slugs(f"{site}/raw", "none") is None


def test_config_errors():
    with pytest.raises(ConfigError, match="unknown field 'site.nope'"):
        load("site: {nope: 1}")
    with pytest.raises(ConfigError) as e:
        load("config_version: 2\npairing: {fallback: [x]}")
    assert all(x in str(e.value) for x in ("config_version", "base_url", "lang_map", "default_lang", "extract.content", "heuristic"))


def test_cli_misuse(tmp_path):
    assert main(["--version"]) == 0 and main(["nope"]) == 2


def test_links_and_media():
    config = load(CONFIG)
    at = "https://old.example.org/ch/news/20260101.php"
    assert rewrite("../support/donate.php", at, config) == "/ch/support/donate"
    assert rewrite("/en/events/index.php", at, config) == "/en/events"
    assert rewrite("../../en/index.php", at, config) == "/en/"
    assert rewrite("detail.php?id=5", at, config) == "/ch/news/detail?id=5"
    for same in ("https://old.example.org/x.php", "#a", "mailto:a@b", "", "JavaScript:x", "//cdn.example/x"):
        assert rewrite(same, at, config) == same
    assert media_relative(resolve(at, "/a%20b.jpg")) == "a b.jpg" and media_relative("https://x/%2e%2e/a") is None and media_relative("https://x/") is None
    assert clean_title("Our Site - Donate", config, True) == "Donate" and clean_title("2026/01/02 News: Camp", config, True) == "Camp"


def test_html():
    doc = parse("<ul><li>a<li><b>b</b><p>x<p>y</ul><div class='k z'><i data-q=1>t</div>")
    assert [n.text() for n in select(doc, "li")] == ["a", "bxy"] and select(doc, "div.z [data-q]")[0].text() == "t" and not select(doc, "div:not(.k)")
    assert to_markdown([parse("<h2>T</h2><p>a <b>b</b> <a href=/x>l</a></p><ol><li>1<li>2</ol>")]) == "## T\n\na **b** [l](/x)\n\n1. 1\n2. 2"
    assert tidy("- \n[](x) a\n![](y)") == "a\n![](y)"


def test_slug_dates_and_paths(spark):
    slugs = {"20190703": "2019-07-03", "07302019": "2019-07-30", "11052018B": "2018-11-05", "gala-20201224-late": "2020-12-24", "2019_gala": None, "88888888": None, "1907": None, "20190229": None, "30072019": "2019-07-30"}
    rows = spark.createDataFrame([(s,) for s in slugs], "s string")
    assert {r[0]: str(r[1]) if r[1] else None for r in rows.select("s", slug_date(rows.s)).collect()} == slugs
    paths = {"content/con.md": True, "content/console.md": False, "a/b:c.md": True, "a./b.md": True, "content/新聞.md": False}
    rows = spark.createDataFrame([(s,) for s in paths], "s string")
    assert {r[0]: r[1] is not None for r in rows.select("s", path_issue(rows.s)).collect()} == paths


def test_yaml_and_csv():
    quoted = ["20260712", "-42", "3.14", "1_000", "no", "Off", "null", "2024-01-18", "2024-1-8", "19:30", "0x1F", "0o17", ".inf", ".5"]
    assert all(frontmatter.needs_quoting(v) for v in quoted) and not frontmatter.needs_quoting("2026_cjgx")
    for v in [*quoted, "a: b", "- x", "it's", "two\nlines", "", "#c", "plain"]:
        assert frontmatter.parse(f"k: {frontmatter.scalar(v)}\n") == {"k": v}
    text = files.csv_text(["a", "b"], [["=1", 'x"y'], ["l\n", None]])
    assert files.read_csv(text) == [["a", "b"], ["'=1", 'x"y'], ["l\n", ""]]


def test_hreflang_verdicts(spark):
    cols = "source_url string, source_route string, source_key string, source_locale string, hreflang string, target_url string, target_route string"
    links = [("u1", "/a", "a", "zh", "en", "v1", "/b"), ("u2", "/b", "b", "en", "zh", "v2", "/a"), ("u3", "/c", "c", "zh", "en", "v3", "/z"), ("u4", "/d", "d", "zh", "en", "v4", "/e"), ("u5", "/f", "f", "zh", "en", "v5", "/e"), ("u6", "/a", "a", "zh", "x-default", "v6", "/e"), ("u7", "/a", "a", "zh", "zh", "v7", "/a"), ("u8", "/g", "/g", "zh", "en", "v8", "/b")]
    routes = spark.createDataFrame([(f"/{k}", k) for k in "abcdef"] + [("/g", "/g")], "route string, key string")
    rows = {r.source_url: r for r in hreflang.validate(spark.createDataFrame(links, cols), routes).collect()}
    assert {k: r.reject_reason for k, r in rows.items()} == {"u1": "", "u2": "", "u3": "not_in_mirror", "u4": "ambiguous_target", "u5": "ambiguous_target", "u6": "x_default", "u7": "self_reference", "u8": "site_level"}
    assert rows["u1"].reciprocal and rows["u7"].reciprocal and not rows["u4"].reciprocal


def test_matching_is_greedy(spark):
    rng = random.Random(4)
    keys = [f"k{i:02d}" for i in range(40)]
    edges = [(a, b, rng.randint(1, 5), rng.random() < 0.2) for i, a in enumerate(keys) for b in keys[i + 1 :] if rng.random() < 0.06]
    taken, want = set(), set()
    for only in (True, False):
        for a in keys:
            best = sorted((-s, b) for x, b, s, d in edges if x == a and (d or not only) and b not in taken)
            if a not in taken and best:
                taken |= {a, best[0][1]}
                want.add((a, best[0][1]))
    df = spark.createDataFrame(pd.DataFrame([(a, b, s, "e", d, "s") for a, b, s, d in edges], columns=["a", "b", "score", "evidence", "declared", "section"]))
    assert {(r.a, r.b) for r in pairing.match(df).collect()} == want


class Site:
    """A client of pages held in memory; ``flaky`` addresses fail once."""

    def __init__(self, pages, flaky=()):
        self.pages, self.flaky, self.asked = pages, set(flaky), []

    def request(self, url, method="GET"):
        self.asked.append(url)
        if url in self.flaky:
            self.flaky.discard(url)
            return None
        return self.pages.get(url, (404, "text/html", b""))


def test_orphans(spark, site, tmp_path):
    engine, at = SiteEngine(spark, load(CONFIG)), "https://old.example.org/en/news/"
    page = _page("n", '<h3>N</h3><img src="n.jpg"><img src="https://cdn.example/o.jpg"><img src="n.exe"><img src="gone.png">').encode()
    pages = {at + f"{s}.php": (200, "text/html", page) for s in ("20250301", "20250301A", "20250301C", "03052025")}
    pages |= {at + "n.jpg": (200, "image/jpeg", b"jpg"), at + "feed.php": (200, "text/xml", b"x")}
    client = Site(pages, [at + "20250301.php"])
    found = engine.probe_orphans(f"{site}/raw", "news", (2025, 2025), "en", client)
    assert found == ["20250301", "20250301A", "03052025"] and at + "20250301C.php" not in client.asked
    assert at + "02142026.php" not in client.asked
    config = load(CONFIG.replace("ch: zh-Hant, en: en", "en: en").replace("default_lang: zh-Hant", "default_lang: en"))
    done = SiteEngine(spark, config).fetch_orphans(f"{tmp_path}/raw", f"{tmp_path}/media", "news", [*found, "feed", "none"], client)
    assert (done["pages_fetched"], done["pages_skipped"], done["assets_fetched"], len(done["errors"])) == (3, 0, 1, 2)
    assert (tmp_path / "raw/en/news/20250301A.php.html").read_bytes() == page and (tmp_path / "media/en/news/n.jpg").read_bytes() == b"jpg"
    assert SiteEngine(spark, config).fetch_orphans(f"{tmp_path}/raw", f"{tmp_path}/media", "news", found, client)["pages_skipped"] == 3
    with pytest.raises(ValueError):
        SiteEngine(spark, config).fetch_orphans(f"{tmp_path}/raw", "m", "../news", found, client)


def test_hash_cache_and_redirect_order(spark, site):
    engine = SiteEngine(spark, load(CONFIG))
    engine.extract(f"{site}/raw", f"{site}/media", f"{site}/cached")
    old = [r[0] for r in files.read_csv((site / "cached/redirect_map.csv").read_text())[1:]]
    assert old == ["https://old.example.org/" + p.removesuffix(".html") for p in sorted(SITE) if "con.php" not in p]
    cache = site / "cached/media_hash_cache.csv"
    rows = files.read_csv(cache.read_text())
    assert [r[0] for r in rows[1:]] == ["en/news/i.jpg", "files/a.pdf"]
    rows[1][3] = "of the cache"  # as long as size and time are the same, the file is not read
    cache.write_text(files.csv_text(rows[0], [*rows[1:], ["broken", "x", "1", "y"], ["short"]], guarded=False))
    report = engine.extract(f"{site}/raw", f"{site}/media", f"{site}/cached")
    assert "of the cache" in (site / "cached/media_manifest.csv").read_text() and not report.stale
    (site / "media/en/news/i.jpg").write_bytes(b"another picture")
    (site / "cached/content/old.md").write_text("x")
    report = engine.extract(f"{site}/raw", f"{site}/media", f"{site}/cached")
    assert "of the cache" not in cache.read_text() and report.stale == ["content/old.md"]
    assert engine.mirror_slugs(f"{site}/raw", "news", "en") == ["02142026"] and engine.mirror_slugs(f"{site}/raw", "news", "fr") is None


def test_thumbnails(spark, tmp_path):
    def jpeg(width, height, turned=None):
        exif = b"Exif\0\0MM\0*\0\0\0\x08" + struct.pack(">HHHIHHI", 1, 0x0112, 3, 1, turned, 0, 0) if turned else b""
        app = b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif if turned else b""
        return b"\xff\xd8" + app + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\0" * 9

    shown = {"a.jpg": (jpeg(2000, 1000), (1000, 500)), "b.JPEG": (jpeg(2000, 1000, 6), (1000, 2000)), "c.jpg": (jpeg(300, 200, 3), (300, 200)), "e.gif": (b"GIF89a" + struct.pack("<HH", 9, 7), (9, 7)), "bad.png": (b"no", (None, None))}
    for name, (data, _) in shown.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "note.txt").write_bytes(b"x")
    plan, made = SiteEngine(spark, load(CONFIG)).thumbnails(str(tmp_path), f"{tmp_path}/none")
    assert {r.media: (r.new_width, r.new_height) for r in plan.collect()} == {k: v for k, (_, v) in shown.items()}
    assert {r.media: r.error for r in made.collect()}["bad.png"] == "not a picture"


def test_stream_keeps_one_page_for_each_path(spark, tmp_path):
    from sitepair.streaming import incremental

    def add(*paths):
        spark.createDataFrame([(p, _page("t", "<p>x</p>")) for p in paths], "rel_path string, html string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        incremental.start(spark, f"{tmp_path}/in", "rel_path string, html string", load(CONFIG), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()

    add("en/a/x.php.html", "en/a/y.php.html", "en/a/X.php.html")
    add("en/a/Y.php.html", "en/a/z.php.html")
    assert sorted(r.rel_path for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["en/a/X.php.html", "en/a/y.php.html", "en/a/z.php.html"]


@pytest.mark.skipif("SITE_DIR" not in os.environ, reason="SITE_DIR and EXPECTED_DIR name a site and its expected outputs")
def test_expected_outputs(spark, tmp_path):
    site, expected = os.environ["SITE_DIR"], Path(os.environ["EXPECTED_DIR"])
    SiteEngine.from_file(spark, f"{site}/config.yaml").extract(f"{site}/raw", f"{site}/media", str(tmp_path))
    for path in filter(Path.is_file, expected.rglob("*")):
        assert (tmp_path / path.relative_to(expected)).read_bytes().replace(b"\r", b"") == path.read_bytes().replace(b"\r", b""), path.name
