from pyspark.sql import functions as F

from quillmill.functions import answers as A
from quillmill.functions import identity as I
from quillmill.functions import text as T
from quillmill.functions.keywords import with_keywords


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_cleaner(spark):
    rows = ["foo-\nbar", "a  b\t cc", "ok\nhello", "text\n12.5 - 3\n(1)[2]\nA1B", "TÃ¼rkÃ§e metin", "Änderung bleibt", "  \n ", None, "|---|---|\nrow"]
    assert values(spark, T.clean_text("x"), rows) == ["foobar", "a b cc", "hello", "text\nA1B", "Türkçe metin", "Änderung bleibt", "", "", "row"]
    assert values(spark, T.clean_text("x", keep_tables=True), ["|---|---|\n|1|2|"]) == ["|---|---|\n|1|2|"]


def test_composed_form_and_words_across_lines(spark):
    assert values(spark, T.clean_text("x"), ["été long", "çok-\nış"]) == ["été long", "çokış"]


def test_pages_are_cleaned_in_place(spark):
    rows = [([(1, "ok\nhello"), (2, None), None],), ([(1, "TÃ¼rkÃ§e metin"), (2, "été  x")],), (None,), ([],)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, pages array<struct<page_number:int,text:string>>")
    got = [r[0] for r in df.orderBy("i").select(T.clean_pages("pages")).collect()]
    assert [x and [(p.page_number, p.text) for p in x] for x in got] == [[(1, "hello"), (2, ""), (None, "")], [(1, "Türkçe metin"), (2, "été x")], None, []]


def test_page_lines(spark):
    lines = ["3", "Page 3", "page3", "3 / 10", "3 of 10", "- 7 -", "– 7 –", "Page 4", "3 of 11", "Section 3"]
    kept = values(spark, T.drop_page_lines("x", F.lit(3), F.lit(10)), ["\n".join(lines)])
    assert kept == ["Page 4\n3 of 11\nSection 3"]


def test_identity(spark):
    assert values(spark, I.document_id("x"), ["Guide.TXT "]) == ["DD94BC4883AC427C"]
    assert values(spark, I.point_id("x", F.lit(0)).cast("string"), ["ABC"]) == ["1621195823420268592"]


def test_language_fold_estimate(spark):
    assert values(spark, T.language("x"), ["çok", "plain", " ", None, "über"]) == ["tr", "en", "unknown", "unknown", "tr"]
    assert values(spark, T.search_fold("x"), ["İIŞĞ Çöü", None]) == ["iisg cou", ""]
    assert values(spark, T.token_estimate("x"), ["abcdefg", "", None]) == [2, 0, 0]
    assert values(spark, T.suspect_count("x"), ["Ã¼Â�a"]) == [3]


def test_sentences_steps_truncation(spark):
    assert values(spark, T.sentences("x"), ["One. Two!  Three? four"]) == [["One.", "Two!", "Three?", "four"]]
    assert values(spark, T.steps("x"), ["1. a\n10. foo - bar"]) == [["1. a", "10. foo - bar"]]
    lists = ["Step 1: open\nStep 2: close", "1. one\n2. two\n10. ten", "• a b\n- c d\n* e", "plain - not a step 3. here"]
    want = [["Step 1: open", "Step 2: close"], ["1. one", "2. two", "10. ten"], ["• a b", "- c d", "* e"], ["plain - not a step 3. here"]]
    assert values(spark, T.steps("x"), lists) == want
    assert values(spark, T.steps("x", compat=True), ["10. foo"]) == [["1", "0. foo"]]
    cut = lambda n: T.truncate_at_sentence("x", F.lit(n))
    assert values(spark, cut(12), ["Aaaa bbbb. Cccc dddd eeee"]) == ["Aaaa bbbb."]
    assert values(spark, cut(8), ["Aaaa bbbb. Cccc dddd eeee"]) == ["Aaaa bbb..."]
    assert values(spark, cut(10), ["Aaaa bbbb cccc"]) == ["Aaaa bbbb..."]
    assert values(spark, T.parent_path("x"), ["A > B > C", "A", None]) == ["A > B", "", ""]


def test_keywords(spark):
    rows = [
        ("How do I reset my password?", "How; reset; password"),
        ("Check ERR-001 in the SAP login screen", "ERR-001; Check; ERR; SAP; check err; check err 001; err 001; sap login; sap login screen; login screen; 001; login; screen"),
        ("Çalışan izin talebi nasıl ilerler?", "çalışan izin; calisan izin; çalışan izin talebi; calisan izin talebi; izin talebi; çalışan; calisan; izin; talebi; ilerler"),
        ('Open "System Failure" via e-commerce', "Open; System; Failure; System Failure; e-commerce; open system; open system failure; commerce"),
        ("", ""),
        (None, ""),
    ]
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(rows)], "i int, question string")
    got = [r.keywords for r in with_keywords(df).orderBy("i").collect()]
    assert ["; ".join(g) for g in got] == [w for _, w in rows]


def test_answers(spark):
    text = "Ans text\n\n---\n📚 **Sources:**\n[1] Guide.txt - Page 2 - A > B\n[2] B.pdf - Page 1"
    assert values(spark, A.clean_answer("x"), [text, "plain", None]) == ["Ans text\n\n---\n📚", "plain", ""]
    found = values(spark, A.parse_sources("x"), [text, "plain", None])
    assert [[(s.doc_name, s.section_title, s.score) for s in f] for f in found] == [[("Guide.txt", "A > B", 0.0), ("B.pdf", None, 0.0)], [], []]
    assert values(spark, A.lacks_information("x"), ["Well. " + A.INSUFFICIENT.upper(), "fine"]) == [True, False]


def test_citations_and_prompt(spark):
    df = spark.createDataFrame([([("a.txt", 2, "S", "t1"), ("", None, "", "t2")],)], "c array<struct<doc_name:string,page:int,section_title:string,text:string>>")
    row = df.select(A.sources_footer("c").alias("f"), A.prompt_context("c").alias("p"), A.prompt(F.lit("q?"), F.lit("ctx")).alias("full")).first()
    assert row.f == "\n\n---\n📚 **Sources:**\n[1] a.txt - Page 2 - S\n[2] "
    assert row.p == "[1] (Source: a.txt, Page: 2, Section: S)\nt1\n\n[2]\nt2"
    assert row.full.endswith("CONTEXT:\nctx\n\nQUESTION: q?\n\nANSWER:")
    one = df.select(A.citation(F.lit("a"), F.lit(3), F.lit("S"), F.lit(1)).alias("x"), A.citation(F.lit(""), F.lit(None).cast("int"), F.lit(""), F.lit(2)).alias("y")).first()
    assert (one.x, one.y) == ("[1] a > Page 3 > S", "[2] Unknown Source")
