"""Names, sanitising, identities and overrides on golden sentences."""

import pytest

from cloakwork.functions.text import latin_fold, norm_name, romanize_hangul, tokenize, utf16_offset
from cloakwork.operators import detect as d
from cloakwork.operators.external import findings_to_spans, is_loopback_url, manual_spans, parse_findings
from cloakwork.operators.iban import find_ibans, is_valid_iban
from cloakwork.operators.identity import link_name_parts, resolve_identities, sanitize_text
from cloakwork.operators.mapping_view import build_mapping_view
from cloakwork.operators.namedb import core_rows
from cloakwork.operators.names import Dictionary, Span, find_names, names_in_address
from cloakwork.operators.structured import EMAIL
import regex

CORE = Dictionary(core_rows())
TIERED = Dictionary([("Latin", "core", "greta"), ("Latin", "ext", "lily"), ("Latin", "ext", "vorbrecht"), ("Latin", "ext", "tamsin")])
IDENT = Dictionary(
    [("Latin", "core", n) for n in "friedrich günther schröder paul eva dirk berg oskar".split()]
    + [("Latin", "ext", n) for n in "schroeder june okafor".split()]
)
HANGUL = Dictionary([("Hangul", "core", n) for n in "박지훈 하은".split()])
GREEK = Dictionary([("Greek", "core", n) for n in "ελένη νικολάου".split()])


def emails(text):
    pattern = regex.compile(EMAIL.replace(r"|\G", ""))
    return [Span(m.start(), m.end(), "EMAIL", m[0], 0.99, "email") for m in pattern.finditer(text)]


def people(text, names):
    return [s.text for s in d.find_people(text, emails(text), names, 0.5)]


@pytest.mark.parametrize(
    "names,text,want",
    [
        (CORE, "Gestern rief Hans-Peter von Stein an.", ["Hans-Peter von Stein"]),
        (CORE, "The note is for Prof. Ixby Quell only.", ["Ixby Quell"]),
        (CORE, "Our supplier Tove Lindqvist agreed.", ["Tove Lindqvist"]),
        (CORE, "We thanked Omar el Sayed again.", ["Omar el Sayed"]),
        (CORE, "We thanked Omar el-Sayed again.", ["Omar el-Sayed"]),
        (CORE, "Signed off by Eng. Tove Lindqvist at noon.", ["Tove Lindqvist"]),
        (CORE, "Account Review Board met twice.", []),
        (CORE, "Call the engineer. Weekly Report follows.", []),
        (CORE, "Will they come? They will.", []),
        (CORE, "Letters from John Anderson and محمد علي arrived.", ["John Anderson", "محمد علي"]),
        (HANGUL, "The parcel went to 박지훈 today.", ["박지훈"]),
        (GREEK, "Η Ελένη Νικολάου έφυγε.", ["Ελένη Νικολάου"]),
        (TIERED, "She grew a Lily there.", []),
        (TIERED, "They saw Vorbrecht there.", []),
        (TIERED, "They saw Greta there.", ["Greta"]),
        (TIERED, "They saw Vorbrecht Tamsin there.", ["Vorbrecht Tamsin"]),
        (TIERED, "They saw Dr. Vorbrecht there.", ["Vorbrecht"]),
        (CORE, "Thanks to Dr. Quillon A. B. Fenwright for this.", ["Quillon A. B. Fenwright"]),
        (CORE, "Slides: https://talks.example.net/2020/john.anderson here.", ["john.anderson"]),
        (CORE, "Shop at https://anderson.net for more.", []),
        (IDENT, "Let Schroeder know at once.", []),
        (IDENT, "Mail p.june@example.org in June.", []),
        (IDENT, "Hotel Krone (info@hotelkrone.de) wrote back.", []),
    ],
)
def test_names(names, text, want):
    assert people(text, names) == want


def test_names_from_addresses():
    assert "Schroeder" in people("Write to fschroeder@example.org and let Schroeder know.", IDENT)
    assert "Ödönke Szczepanowicz" in people("Ödönke Szczepanowicz (szczepanowicz@example.org) called twice.", IDENT)
    assert names_in_address("fschroeder", IDENT) == [("schroeder", "family")]
    assert names_in_address("friedrich.schroeder", IDENT) == [("friedrich", "given"), ("schroeder", "family")]
    assert names_in_address("office", IDENT) == [] and names_in_address("x.y", IDENT) == []
    # the names are looked up where they are, not copied
    derived = IDENT.with_core(["zz"])
    assert derived.names["Latin"].base is IDENT.names["Latin"] and derived.tier("zz") == 2 and derived.tier("june") == 1


def pseudonyms(text, names):
    from cloakwork.operators.mapping_view import resolve_spans

    spans = resolve_spans([*emails(text), *d.find_people(text, emails(text), names, 0.5)])
    links = link_name_parts(spans)
    out, rows = sanitize_text(text, spans, "pseudonymize", links)
    return out, *resolve_identities(spans, rows, text)


@pytest.mark.parametrize(
    "names,text,want",
    [
        (CORE, "John Anderson rang. Then John Anderson wrote.", "[PERSON_1] rang. Then [PERSON_1] wrote."),
        (CORE, "John Anderson saw Michael Smith.", "[PERSON_1] saw [PERSON_2]."),
        (IDENT, "Oskar van der Berg schrieb. Oskar kam.", "[PERSON_1] schrieb. [PERSON_1] kam."),
        (IDENT, "Oskar van der Berg schrieb. Herr van der Berg kam.", "[PERSON_1] schrieb. Herr [PERSON_1] kam."),
        (
            IDENT,
            "Oskar van der Berg und Oskar Schröder kamen. Oskar blieb.",
            "[PERSON_1] und [PERSON_2] kamen. [PERSON_3] blieb.",
        ),
        (IDENT, "Oskar van der Berg schrieb. Oskar's Brief kam.", "[PERSON_1] schrieb. [PERSON_1]'s Brief kam."),
    ],
)
def test_pseudonyms(names, text, want):
    assert pseudonyms(text, names)[0] == want


def test_identities():
    _, _, ids = pseudonyms("Günther Schröder asked; write to gschroeder@example.org at once.", IDENT)
    assert [(i.label, i.placeholders) for i in ids] == [("Günther Schröder", ["[PERSON_1]", "[EMAIL_1]"])]
    _, _, ids = pseudonyms("Eva Paul saw gschroeder@example.org.", IDENT)
    assert ids == []


def given():
    text = "Tamsin owes Odo. tamsin@q.org Tamsin knows."
    at = [(0, 6, "PERSON"), (12, 15, "PERSON"), (17, 29, "EMAIL"), (30, 36, "PERSON")]
    return text, [Span(s, e, k, text[s:e], 0.9, "x") for s, e, k in at]


def test_mapping_view():
    text, spans = given()
    view = build_mapping_view(text, spans, "pseudonymize")
    assert view.text == "[PERSON_1] owes [PERSON_2]. [EMAIL_1] [PERSON_1] knows."
    off = build_mapping_view(text, spans, "pseudonymize", disabled=frozenset({"PERSON:odo"}))
    assert off.text == "[PERSON_1] owes Odo. [EMAIL_1] [PERSON_1] knows." and off.removed == [("PERSON:odo", "PERSON", "Odo")]
    t = "Wibke and Oltmanns agree."
    pair = [Span(0, 5, "PERSON", "Wibke", 0.9, "x"), Span(10, 18, "PERSON", "Oltmanns", 0.9, "x")]
    one = build_mapping_view(t, pair, "pseudonymize", assignments={"PERSON:wibke": -1, "PERSON:oltmanns": -1}, custom=[(-1, "W")])
    assert one.text == "[PERSON_1] and [PERSON_1] agree."
    with pytest.raises(ValueError):
        sanitize_text(t, pair, "other")


def test_external():
    assert [(s.start, s.end) for s in manual_spans("Ann saw Annika and a manner.", [("PERSON", "Ann")])] == [(0, 3)]
    assert parse_findings('```json\n{"findings": [{"type": "email", "text": "q"}]}\n```') == [("EMAIL", "q")]
    assert parse_findings('Here you are {"findings": [{"type": "IP", "text": "10.9.8.7"}]} bye') == [("IP", "10.9.8.7")]
    assert parse_findings("no findings") == [] and parse_findings('{"other": 1}') == []
    got = findings_to_spans("write ed@q.org", [("EMAIL", "ED@Q.ORG"), ("OTHER", "write")])
    assert [s.text for s in got] == ["ed@q.org"]
    assert is_loopback_url("http://127.0.0.1:8080/v1") and not is_loopback_url("http://q.org")


def test_text_primitives():
    assert [latin_fold(w) for w in ("Sørensen", "Weiß", "Æsop", "Yıldız")] == ["Sorensen", "Weiss", "AEsop", "Yildiz"]
    assert norm_name("Schröder") == "schroeder" and romanize_hangul("서울") == "seoul"
    assert [t.text for t in tokenize("Paul's d'Arcy el-Sayed")] == ["Paul", "d'Arcy", "el-Sayed"]
    assert utf16_offset("😀a", 2) == 3
    assert is_valid_iban("NL91ABNA0417164300") and not is_valid_iban("NL91ABNA0417164301")
    assert find_ibans("NL91 ABNA 0417 1643 00 EUR 20 GB82 WEST 1234 5698 7654 32 EUR 9")[1].text == "GB82 WEST 1234 5698 7654 32"
    assert find_names("", CORE, 0.5) == [] and len(find_names("Paul " * 50_000, IDENT, 0.5)) == 1


def test_words_match_tokens(spark):
    """The JVM's words are those of the tokenizer."""
    texts = ["Paul's d'Arcy el-Sayed's 's x's It’s", "Ελένη 박지훈 محمد علي ½ a1b", "x" * 20_000 + " ´a` -b- c--d", None, "", "éa\u0301b नमस्ते ไทย 漢字 ქართული"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    want = sorted((i, t.text, t.script) for i, x in enumerate(texts) if x for t in tokenize(x))
    assert sorted(map(tuple, d.word_table(df, "i").collect())) == want
    placed = d.token_table(df, "i").collect()
    assert sorted((r["i"], r["text"], r["script"]) for r in placed) == want
    assert all(texts[r["i"]][r["start"] : r["end"]] == r["text"] for r in placed)


def test_sanitize(spark):
    df = spark.createDataFrame([("Mail ed@example.org to John Anderson.",), (None,), ("",)], "text string")
    rows = d.sanitize(df, mode="redact").collect()
    assert [r["sanitized"] for r in rows] == ["Mail [EMAIL] to [PERSON].", None, ""]
    assert [m["placeholder"] for m in rows[0]["mapping"]] == ["[EMAIL]", "[PERSON]"] and rows[0]["identities"] is None
    s = d.segments(d.detect(df.limit(1))).first()["segments"]
    assert "".join(x["text"] for x in s) == "Mail ed@example.org to John Anderson."
