import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.lexicon import default_lexicon
from loomgraph.operators import chunking, extraction, resolution
from loomgraph.schema import invalid, validate
from loomgraph.settings import Settings
from loomgraph.sources import markdown

NOTE = "---\ntitle: Acme: the case\ndocument_id: zed\nflag: True\nflag: false\n# c: d\n\nno colon\n---\nPre text\n\n# Top\n\n## Empty\n\n### Deep\n\nBody.\n\n## Next\nMore.\n"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("/x/my_note.v2.md", "# Simple Note\n\nOne paragraph.\n"), ("/x/z.md", NOTE), ("/x/plain_text.md", "no heading"), ("/x/empty.md", ""), ("/x/none.md", None)]
    return {r.document_id: r for r in markdown.parse_documents(spark.createDataFrame(rows, "file_path string, raw_text string")).collect()}


def test_defaults_without_front_matter(docs):
    d = docs["my_note.v2"]
    assert (d.title, d.department, d.access_tier, d.version, d.metadata) == ("Simple Note", "General", "Internal", "1.0", {})
    assert docs["plain_text"].title == "Plain Text" and docs["plain_text"].content == "no heading"
    assert docs["empty"].sections == [] and "none" not in docs


def test_front_matter_and_sections(docs):
    d = docs["zed"]
    assert d.metadata == {"title": "Acme: the case", "document_id": "zed", "flag": "false"}
    assert [(s.level, s.title, s.content, s.path) for s in d.sections] == [
        (1, "Acme: the case", "Pre text", "Acme: the case"), (3, "Deep", "Body.", "Top > Empty > Deep"), (2, "Next", "More.", "Top > Next")]


def test_directory_order(spark, tmp_path):
    (tmp_path / "b.md").write_text("b")
    (tmp_path / "a.md").write_text("# A\r\n\r\na")
    (tmp_path / "c.txt").write_text("c")
    rows = markdown.load_directory(spark, str(tmp_path)).orderBy("doc_seq").collect()
    assert [(r.doc_seq, r.document_id, r.title) for r in rows] == [(1, "a", "A"), (2, "b", "B")]


# A plain restatement of the packing rules, to check the folds against.


def plain_sentences(text, limit, overlap):
    out, buf, size = [], [], 0
    for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)):
        if not s:
            continue
        if buf and size + len(s) + 1 > limit:
            out.append(" ".join(buf))
            kept, total = [], 0
            while buf and total + len(buf[-1]) + 1 <= overlap:
                total += len(buf[-1]) + 1
                kept = [buf.pop()] + kept
            buf = kept
            size = total
        buf = buf + [s]
        size += len(s) + 1
    return out + ([" ".join(buf)] if buf else [])


def plain_paragraphs(text, limit, overlap, least):
    out, buf, size = [], [], 0
    for p in (x.strip() for x in re.split(r"\n\s*\n", text.strip())):
        if not p:
            continue
        if len(p) > limit:
            out += (["\n\n".join(buf)] if buf else []) + plain_sentences(p, limit, overlap)
            buf, size = [], 0
        elif buf and size + len(p) + 2 > limit:
            out.append("\n\n".join(buf))
            buf, size = [p], len(p)
        else:
            buf, size = buf + [p], size + len(p) + 2
    if buf:
        last = "\n\n".join(buf)
        if out and len(last) < least and len(out[-1]) + len(last) + 2 <= 1.2 * limit:
            out[-1] += "\n\n" + last
        else:
            out.append(last)
    return out


def test_packing_equals_plain_rules(spark):
    own = random.Random(5)
    words = lambda n: " ".join(own.choice(["alpha", "be", "gamma.", "d!", "épsilon"]) for _ in range(n))
    texts = ["", " \n\n ", "x" * 300] + ["\n\n".join(words(own.randint(1, 40)) for _ in range(own.randint(1, 6))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.p for r in df.select("i", chunking.pack_paragraphs(F.col("t"), 120, 30, 20).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_paragraphs(t, 120, 30, 20), t


def test_chunk_ids_and_metadata(spark):
    body = "\n\n".join(f"Paragraph {i} on OAuth  2.1 and AWS." for i in range(1100))
    row = ("d", "T", "Sales", " confidential ", "1", body, [], {})
    df = spark.createDataFrame([row, ("e", "T", "Sales", "odd", "1", None, [], {})], "document_id string, title string, department string, access_tier string, version string, content string, sections array<struct<level:int,title:string,content:string,path:string>>, metadata map<string,string>")
    rows = chunking.chunk_documents(df, Settings(chunk_size=40, chunk_overlap=0, min_chunk_size=0)).orderBy("index").collect()
    assert len(rows) == 1100 and rows[0].chunk_id == "chunk_d_001" and rows[-1].chunk_id == "chunk_d_1100"
    m = rows[0].metadata
    assert (m.access_tier, m.section_path, m.entity_hints, m.word_count, m.estimated_tokens) == ("Confidential", "T", ["AWS", "OAuth 2.1"], 7, 8)


@pytest.fixture(scope="module")
def sample(spark):
    t = "Acme Corp relies on Product Nova hosted in AWS regions. Product Nova depends on Identity Service for tokens. v3.2 brought OAuth  2.1."
    rows = [("c1", "d", t), ("c2", "d", None), ("c3", "d", "The renovation process of Nova."), ("c4", "d", "GDPR only.")]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, text string")


def test_entities_of_a_chunk(sample):
    rows = extraction.extract_entities(sample).where("chunk_id = 'c1'").orderBy("pos").collect()
    assert [(r.name, r.type) for r in rows] == [("Product Nova", "PRODUCT"), ("Identity Service", "SERVICE"), ("Acme Corp", "CUSTOMER"), ("OAuth 2.1", "TECHNOLOGY"), ("AWS", "TECHNOLOGY"), ("Version 3.2", "VERSION")]
    assert rows[5].aliases == ["v3.2"] and rows[5].id == "entity:version:version_3_2"
    assert extraction.extract_entities(sample).where("chunk_id in ('c2', 'c3')").count() == 0


def test_relations_have_a_direction(sample):
    rows = {(r.source_id, r.type, r.target_id) for r in extraction.extract_relations(sample).collect()}
    assert ("entity:acme_corp", "DEPENDS_ON", "entity:product_nova") in rows
    assert ("entity:product_nova", "DEPENDS_ON", "entity:identity_service") in rows
    assert ("entity:product_nova", "DEPLOYS_TO", "entity:aws") in rows
    assert not {(t, k, s) for s, k, t in rows} & rows


def test_mentions_become_canonical(spark):
    names = ["Nova", "Product Nova", "IdP", "Identity Service", "the new nova platform", "Unknown Thing", None]
    rows = [(i, n, "PRODUCT" if i else None, "d" * i, ["a", "a", None], {}) for i, n in enumerate(names)]
    m = spark.createDataFrame(rows, "mention_seq long, name string, type string, description string, aliases array<string>, metadata map<string,string>")
    out = {r.canonical_id: r for r in resolution.canonical_entities(m, default_lexicon(spark)).collect()}
    assert set(out) == {"entity:product:nova", "entity:service:identity_service", "entity:product:unknown_thing"}
    assert out["entity:product:nova"].source_mentions == ["Nova", "Product Nova", "the new nova platform"]
    assert out["entity:product:unknown_thing"].aliases == ["a"]


def test_relations_are_merged(spark):
    ev = lambda *cs: [(c, "d", "t", 0.9) for c in cs]
    rows = [
        (1, "entity:customer:acme_corp", "entity:inc_402", "AFFECTS", "first", 1.0, ev("c1", "c1")),
        (2, "entity:acme_corp", "entity:incident:inc_402", "AFFECTS", "second", 1.0, ev("c1", "c2")),
        (3, "entity:acme", "entity:acme_corp", "USES", "loop", 1.0, ev("c1")),
        (4, "Odd Name", None, "USES", "null end", 1.0, []),
        (5, "entity:thing:odd_name", "entity:nova", "USES", "new", 2.0, []),
    ]
    df = spark.createDataFrame(rows, "rel_seq long, source_id string, target_id string, type string, description string, weight double, evidence array<struct<chunk_id:string,document_id:string,text:string,confidence:double>>")
    lex = default_lexicon(spark)
    none = spark.createDataFrame([], "canonical_id string, canonical_name string, aliases array<string>, source_mentions array<string>")
    out = {r.id: r for r in resolution.resolve_relations(df, lex, none).collect()}
    assert set(out) == {"rel:customer_acme_corp:affects:incident_inc_402", "rel:odd_name:uses:product_nova"}
    one = out["rel:customer_acme_corp:affects:incident_inc_402"]
    assert (one.weight, one.description, [e.chunk_id for e in one.evidence]) == (1.5, "first", ["c1", "c1", "c2"])


def test_validation(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 1.5)], "i int, confidence double")
    assert [r.i for r in invalid(df, "evidence").collect()] == [3]
    assert validate(df.where("i < 3"), "evidence").count() == 2
    with pytest.raises(Exception):
        validate(df, "evidence").collect()
