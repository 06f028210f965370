import pytest
from pyspark.sql import functions as F

from quillspark.functions import templates as TPL
from quillspark.kernel.tex import tokenize
from quillspark.kernel.xmltree import XmlBuilder, XmlElement
from quillspark.operators import lines as L


def test_template_errors():
    for bad in ("$if(x)$", "$endif$", "$for(x)$$endif$", "$else$"):
        with pytest.raises(TPL.TemplateError):
            TPL.parse(bad)


def test_template(spark):
    df = spark.createDataFrame([("A", "3"), (None, "x")], "a string, n string")
    v = {"a": F.col("a"), "n": F.col("n")}
    got = [r[0] for r in df.select(TPL.render("${a:none} $if(n > 2)$big$else$small$endif$ $ifnot(a)$no a$endif$${missing}", v)).collect()]
    assert got == ["A big ", "none small no a"]
    with pytest.raises(TPL.TemplateError):
        TPL.render("$partial(p)$", v)


def test_tex():
    got = tokenize("\\alpha1{x}%c\n a-b 9\\\\~")
    assert [t[:2] for t in got] == [("control sequence", "alpha1"), ("group start", "{"), ("word", "x"), ("group end", "}"), ("comment", "c"), ("newline", "\n"), ("whitespace", " "), ("word", "a-b"), ("whitespace", " "), ("symbol", "9"), ("control sequence", "\\"), ("active character", "~"), ("EOF", "")]
    assert got[7][2:] == (2, 2)


def test_xml_builder():
    b = XmlBuilder().start("a", x='"&\n').text("<").start("b").end().cdata("]]>").comment("a--b")
    assert b.finish() == '<a x="&quot;&amp;&#10;">&lt;<b /><![CDATA[]]]]><![CDATA[>]]><!--a- -b--></a>'
    e = XmlElement("r", {}, ["t", XmlElement("c", {"k": "v"}), XmlElement("c")])
    assert e.to_xml() == '<r>t<c k="v" /><c /></r>' and e.find_child("c").attrs == {"k": "v"} and len(e.find_children("c")) == 2 and e.find_child("z") is None


def test_definition_lists(spark):
    docs = spark.createDataFrame([(1, "T\n: a\n: b\nno\n\n: lost\nU\n: c"), (2, None), (3, "")], "doc_id long, text string")
    d = L.definition_lists(docs)
    assert sorted((r["term"], r["definitions"]) for r in d.collect()) == [("T", ["a", "b"]), ("U", ["c"])]
    assert L.definition_html(d).first()["html"] == "<dl>\n<dt>T</dt>\n<dd>a</dd>\n<dd>b</dd>\n<dt>U</dt>\n<dd>c</dd>\n</dl>"
    assert d.where("term = 'T'").select(L.definition_markdown(F.col("term"), F.col("definitions"))).first()[0] == "T\n: a\n: b"


def test_abbreviations(spark):
    docs = spark.createDataFrame([(1, "HTML and HTML5, XHTML\n*[HTML]: Hyper \"T\"\n*[HTML5]: Five"), (2, "plain"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in L.with_abbreviations(docs).collect()}
    assert got[1] == '<abbr title="Hyper &quot;T&quot;">HTML</abbr> and <abbr title="Five">HTML5</abbr>, XHTML' and got[2] == "plain" and got[3] is None
