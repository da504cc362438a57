"""Queries and their SQL over small tables that stand on a border or end in odd places."""

import duckdb

from sitelode import plans


def page(text, title="T", more=""):
    return f"<!DOCTYPE html><html><head><title>{title}</title></head><body><article><h1>{title}</h1><p>{text}</p>{more}</article><footer>f</footer></body></html>"


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL. tables: columns with their types, rows."""
    db = duckdb.connect()
    for table, (columns, rows) in tables.items():
        db.execute(f"CREATE TABLE {table} ({columns})")
        db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        db.execute(f"COPY {table} TO '{folder}/{table}.parquet' (FORMAT parquet)")
    want = db.execute(plans.oracles()[name])
    names = [c[0] for c in want.description]
    return sorted(map(tuple, plans.queries()[name](spark, str(folder)).select(*names).collect())), sorted(want.fetchall())


def pages(*rows):
    return "page_id BIGINT, url VARCHAR, html VARCHAR", [(i, "", html) for i, html in rows]


def test_ai_visibility_on_the_border_of_figures(spark, tmp_path):
    got, want = both(spark, tmp_path, "ai_visibility", pages=pages(*[(9 * n + 5, page("word " * n)) for n in (309, 310)]))
    assert got == want and len({r[6] for r in want}) == 2


def test_eeat_categories_on_the_border_of_length(spark, tmp_path):
    got, want = both(spark, tmp_path, "eeat_categories", pages=pages(*[(9 * n + 5, page("word " * n)) for n in (1490, 1491)]))
    assert got == want and {r[2] for r in want if r[1] == "expertise"} == {2, 5}


def test_eeat_score_on_the_border_of_length(spark, tmp_path):
    rows = [(9 * n + 5, page("word " * n)) for n in (1490, 1491)] + [(9 * n + 8, page("word " * n, title="token = &quot")) for n in (1494, 1495, 1496)]
    got, want = both(spark, tmp_path, "eeat_score", pages=pages(*rows))
    assert got == want and len(want) == 5


def test_eeat_score_on_the_border_of_length_by_what_follows_the_copy(spark, tmp_path):
    """Each of the nine endings of a page crosses the border once, be its last paragraph closed or not, and earns 3 points by it."""
    closed = lambda n: page("<b>" + "wört " * n + "&amp; ende.")
    rows = [(m, n, html) for m in range(9) for n in range(1440 if m == 4 else 1476, 1500) for html in (closed(n), closed(n).replace("</p></article>", "<br></article>"))]
    got, want = both(spark, tmp_path, "eeat_score", pages=("page_id BIGINT, url VARCHAR, html VARCHAR", [(99 * i + m, "", html) for i, (m, _, html) in enumerate(rows)]))
    earned = [{r[1] for r in want if r[0] % 99 == m} for m in range(9)]
    assert got == want and [max(e) - min(e) for e in earned] == [3] * 9 and all(len(e) == 2 for e in earned)


def test_geo_score_by_what_follows_the_heading(spark, tmp_path):
    open_ = [page("w " * n + "<br>").replace("</p></article>", "</article>") for n in (30, 37, 39, 45, 58, 60)]
    got, want = both(spark, tmp_path, "geo_score", pages=pages(*[(m + 9 * (9 * n + m), html) for n, html in enumerate(open_) for m in range(9)], (1000, page("w " * 50)), (1001, page("token = &quot"))))
    assert got == want and len(want) == 56


def test_geo_score_of_bylines_and_figures(spark, tmp_path):
    texts = ("By By By " + "w " * 40, "6x 7x 50.222 mil " + "w " * 90, "3 million 4%", "Por Por Por")
    got, want = both(spark, tmp_path, "geo_score", pages=pages(*[(90 * n + m, page(t)) for n, t in enumerate(texts) for m in (2, 4, 6, 8)]))
    assert got == want


def test_publishing_entities_of_cut_titles(spark, tmp_path):
    titles = ("call +1 (907) 555-", "a - b |", "token = &quot", "x - ", "a--", "-", "", "a &amp", "a&am", "a | b - c", "a -|")
    got, want = both(spark, tmp_path, "publishing_entities", pages=pages(*[(168 * n + m, page("w", title=t)) for n, t in enumerate(titles) for m in (1, 2, 3, 6, 9)]))
    assert got == want and {"call +1 (907) 555-", "token = &quot"} <= {r[1] for r in want}


def test_phrases_with_a_letter_that_has_no_capital(spark, tmp_path):
    items = [(0, "Straße frei"), (12, "Straße frei"), (1, "Straße 7 frei"), (24, "Öl"), (36, "ß")]
    texts = [(0, "die straße frei"), (1, "DIE STRASSE FREI"), (2, "Straße 7"), (3, "strasse"), (4, "öl, ß"), (5, None), (6, "ss ol")]
    got, want = both(spark, tmp_path, "phrase_naming", documents=("doc_id BIGINT, text VARCHAR", texts), benchmark=("item_id BIGINT, text VARCHAR", items))
    assert got == want and {(0, 0), (4, 36), (4, 24)} <= set(want)


def test_subject_entities_of_headings_as_they_stand(spark, tmp_path):
    titles = ("Ly.&amp;&amp; Ones and&amp", "token = &quot;2abc&quot; x", "a Straße weit frei", "Straße weit &am", "x&amp;y z&amp;z w v", "w", "Öl&quot im See")
    got, want = both(spark, tmp_path, "subject_entities", pages=pages(*[(15 * n + m, page("w", title=t)) for n, t in enumerate(titles) for m in range(15)]))
    assert got == want and len(want) == 105
