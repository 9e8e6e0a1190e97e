from logtide.llm import html

LINE = "The second of the blocks is long enough to be decided by itself, and it stays."


def test_open_head_ends_where_the_body_begins():
    assert html.extract(f"<head><title>x</title><body><article><p>{LINE}</article>") == LINE
    assert html.extract(f"<html><head><title>x</title><style>p{{}}</style><article><p>{LINE}</p></article>") == LINE
    assert html.extract(f"<head><meta charset=utf-8><noscript><img src=a></noscript><title>x</title><main>{LINE}</main>") == LINE
    assert html.extract(f"<head><title>x</title>{LINE}<p>{LINE}") == f"{LINE}\n{LINE}"
    assert html.extract(f"<head><noscript><p>{LINE}</p></noscript><title>{LINE}</title></head><body><article>{LINE}</article>") == LINE


def test_links_in_an_article_stay():
    page = f"<body><nav><a href=n>menu</a></nav><article><h1>Head</h1><p><a href=a>{LINE}</a></p><ul><li><a href=b>One link</a></li></ul><nav><a href=c>more</a></nav></article><p><a href=d>{LINE}</a></p>"
    assert html.extract(page) == f"Head\n{LINE}\nOne link"
    assert html.extract("<article><h2>Short</h2><p><a href=a>All of it is one link</a></p></article>") == "Short\nAll of it is one link"
    assert html.extract(f"<p>{LINE}</p><p><a href=a>{LINE}</a></p>") == LINE


def test_names_around_and_beside_an_article():
    assert html.extract(f'<div class="content with-sidebar"><article><p>{LINE}</p></article></div>') == LINE
    assert html.extract(f'<div class="sidebar"><main><p>{LINE}</p><div class="comment-list"><p>{LINE}</p></div></main></div>') == LINE
    assert html.extract(f'<article><p>{LINE}</p></article><aside class="related"><article><p>{LINE}</p></article></aside>') == LINE
    assert html.extract(f'<div class="has-banner">{LINE}</div><div id="site_footer">{LINE}</div>') == LINE


def test_two_densities():
    sparse = "wxyz " * 13 + "the of "
    assert 70 <= len(sparse) < 200
    middling = " ".join(["wxyz wxyz wxyz wxyz wxyz the"] * 10)
    bare = "wxyz " * 60
    page = lambda *x: "".join(f"<p>{b}</p>" for b in x)
    assert html.extract(page(middling)) == middling
    assert html.extract(page(bare)) == ""
    assert html.extract(page(LINE, sparse)) == f"{LINE}\n{sparse.strip()}"
    assert html.extract(page(bare, sparse, bare)) == ""
    assert html.extract(f"<article>{page(bare)}</article>") == bare.strip()


def test_query_equals_a_plain_reading_of_the_articles(spark, tmp_path):
    import html as chars
    import re

    from logtide.llm import queries

    d = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in queries.op5_html(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        found = re.search(r"(?s)<article.*?>(.*)</article>", r.html)
        assert found
        body = re.sub(r"(?s)<(script|style|aside|nav|form|footer)\b.*?</\1>|<!--.*?-->", "", found[1])
        body = re.sub(r'(?s)<(div|section|ul) (?:class|id)="[^"]*(?:comment|ad|share|related|promo)[^"]*".*?</\1>', "", body)
        body = re.sub(r"<br ?/?>", " ", body)
        blocks = (" ".join(chars.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h\d|ul|ol|li|div|blockquote|pre|table|tr|td|th|section|figure|figcaption|header|hr)\b[^>]*>", body))
        assert got[r.page_id].text == "\n".join(b for b in blocks if b), r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_nulls_repeats_long_pages_and_other_columns(spark):
    long = "<article>" + f"<p>{LINE}</p>" * 20000 + "</article>"
    rows = [(None, None, None, 1), (1, "u", "", 2), (2, "u", long, 3), (2, "u", long, 3), (3, None, f"<p>{LINE}", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, id int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html.main_text(df).collect()), key=str)
    text = "\n".join([LINE] * 20000)
    assert got == sorted([(None, None, "", 0), (1, "u", "", 0), (2, "u", text, len(text)), (2, "u", text, len(text)), (3, None, LINE, len(LINE))], key=str)
    assert html.main_text(df.limit(0)).count() == 0
