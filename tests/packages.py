"""Small Word packages and PNG files, written by the tests themselves."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape, quoteattr

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'


def fonts(name: str) -> str:
    return "<w:rFonts " + " ".join(f"w:{a}={quoteattr(name)}" for a in ("ascii", "hAnsi", "eastAsia", "cs")) + "/>"


def spacing(before: int, after: int, line: int) -> str:
    return f'<w:spacing w:before="{before}" w:after="{after}" w:line="{line}" w:lineRule="auto"/>'


def style(sid, font, size, align, before=0, after=0, line=240, bold=False, italic=False, first=None, base="Normal", name=None) -> str:
    default = ' w:default="1"' if base is None else ""
    indent = f'<w:ind w:firstLine="{first}"/>' if first is not None else ""
    based = f'<w:basedOn w:val="{base}"/>' if base else ""
    marks = "<w:b/>" * bold + "<w:i/>" * italic
    return f'<w:style w:type="paragraph" w:styleId="{sid}"{default}><w:name w:val="{name or sid}"/>{based}<w:pPr>{spacing(before, after, line)}{indent}<w:jc w:val="{align}"/></w:pPr><w:rPr>{fonts(font)}{marks}<w:sz w:val="{size}"/></w:rPr></w:style>'


def styles(wrong: bool) -> str:
    """The style sheet of a two-column manuscript, right or with deviations."""
    base, arial, body = ("Calibri", "Arial", "Arial") if wrong else ("Times New Roman",) * 3

    def of(right, other):
        return other if wrong else right

    made = [
        style("Normal", base, of(20, 22), "left", base=None), style("BodyText", body, of(20, 24), of("both", "center"), after=of(0, 240), line=of(240, 360), first=of(289, 0), name="Body Text"),
        style("PaperTitle", arial, of(48, 32), of("center", "left"), after=of(120, 360), name="Paper Title"), style("Authors", base, of(22, 24), "center", after=60), style("Affiliation", base, of(18, 22), "center", after=120, italic=True),
        style("AbstractText", body, of(18, 22), "both", after=60, line=of(240, 360), name="Abstract Text"), style("Keywords", body, of(18, 22), "both", after=120),
        style("Heading1", arial, of(20, 28), of("center", "left"), before=of(120, 240), after=60, bold=True, name="Heading 1"), style("Heading2", base, of(20, 24), "left", before=120, after=40, italic=not wrong, name="Heading 2"),
        style("Heading3", base, of(20, 24), "left", before=80, after=40, italic=not wrong, name="Heading 3"), style("Caption", arial, of(16, 22), of("center", "left"), before=40, after=80), style("TableText", arial, of(16, 22), "left", name="Table Text"),
    ]
    return f"<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr>{fonts(base)}<w:sz w:val='{of(20, 22)}'/></w:rPr></w:rPrDefault><w:pPrDefault><w:pPr>{spacing(0, 0, 240)}</w:pPr></w:pPrDefault></w:docDefaults>{''.join(made)}</w:styles>"


def run(text: str, props: str = "") -> str:
    return f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def para(sid: str, *content: str, props: str = "") -> str:
    return f'<w:p><w:pPr><w:pStyle w:val="{sid}"/>{props}</w:pPr>{"".join(content)}</w:p>'


def body(wrong: bool = False, columns: int = 2) -> str:
    """Front matter, three headings, body text with a bookmark, a link, a field and notes, an equation, an image, captions, a
    table."""
    tag = "crooked" if wrong else "straight"
    rich = [
        run("Readers may follow the "), '<w:bookmarkStart w:id="1" w:name="Mark"/>', run("marked passage"), '<w:bookmarkEnd w:id="1"/>', run(", open some "), f'<w:hyperlink r:id="rIdLink">{run("web page")}</w:hyperlink>', run(", check where the field ("),
        '<w:r><w:fldChar w:fldCharType="begin"/></w:r>', '<w:r><w:instrText xml:space="preserve"> REF Mark \\h </w:instrText></w:r>', '<w:r><w:fldChar w:fldCharType="separate"/></w:r>', run("marked passage"),
        '<w:r><w:fldChar w:fldCharType="end"/></w:r>', run(") points, read a note below"), '<w:r><w:footnoteReference w:id="1"/></w:r>', run(", and one behind the text"), '<w:r><w:endnoteReference w:id="1"/></w:r>', run(f" of the {tag} copy."),
    ]
    loud = f"{fonts('Courier New')}<w:b/><w:sz w:val='28'/>" if wrong else ""
    cell_props = f"{fonts('Arial')}<w:sz w:val='24'/>" if wrong else ""
    rows = [("Beach", "Pebbles"), ("Northern", "Many"), ("Southern", "Hardly any")]
    cells = "".join("<w:tr>" + "".join(f'<w:tc><w:tcPr><w:tcW w:w="2600" w:type="dxa"/></w:tcPr>{para("TableText", run(t, cell_props + "<w:b/>" * (i == 0)))}</w:tc>' for t in r) + "</w:tr>" for i, r in enumerate(rows))
    page = '<w:pgSz w:w="16838" w:h="11906" w:orient="landscape"/><w:pgMar w:top="1440" w:right="1440" w:bottom="1440" w:left="1440" w:header="720" w:footer="720" w:gutter="0"/><w:cols w:equalWidth="1" w:num="1" w:space="720"/>' if wrong else (
        f'<w:pgSz w:w="12240" w:h="15840" w:orient="portrait"/><w:pgMar w:top="1080" w:right="720" w:bottom="1080" w:left="720" w:header="360" w:footer="360" w:gutter="0"/><w:cols w:equalWidth="1" w:num="{columns}" w:space="360"/>'
    )
    blocks = [
        para("PaperTitle", run("Counting Pebbles on Quiet Beaches")), para("Authors", run("Mira Lund, Tomas Reyes")), para("Affiliation", run("Harbour Institute for Shore Studies, Northport")),
        para("AbstractText", run("Abstract—We count pebbles on four beaches through one winter and compare what the tides leave there.")), para("Keywords", run("Index Terms—pebbles, tides, winter.")), para("Heading1", run("I. INTRODUCTION")),
        para("BodyText", *rich, props=f'{spacing(0, 240, 360)}<w:jc w:val="center"/>' if wrong else ""), para("Heading2", run("A. Where We Walked")),
        para("BodyText", run("Every beach was walked twice a week, always at low water and from its northern end.", loud), props=f'{spacing(0, 360, 480)}<w:jc w:val="right"/>' if wrong else ""), para("Heading3", run("1) Tools Carried")),
        para("BodyText", run("We carried a bucket, two sieves, a folding rule, some chalk, a lamp and a waterproof book.")), para("BodyText", "<m:oMath><m:r><m:t>E = mc²</m:t></m:r></m:oMath>", props='<w:jc w:val="center"/>'),
        para("BodyText", '<w:r><w:drawing><wp:inline><wp:extent cx="914400" cy="914400"/></wp:inline></w:drawing></w:r>', props='<w:jc w:val="center"/>'), para("Caption", run("Fig. 1. The northern beach at low water.")), para("Caption", run("TABLE I. PEBBLES BY BEACH")),
        f'<w:tbl><w:tblPr><w:tblW w:w="0" w:type="auto"/><w:tblLayout w:type="fixed"/></w:tblPr><w:tblGrid><w:gridCol w:w="2600"/><w:gridCol w:w="2600"/></w:tblGrid>{cells}</w:tbl>', f"<w:sectPr>{page}</w:sectPr>",
    ]
    return f"<w:document {W}><w:body>{''.join(blocks)}</w:body></w:document>"


def package(document: str, style_sheet: str | None = None, **more: str | bytes) -> bytes:
    out = io.BytesIO()
    notes = {f"word/{k}s.xml": f'<w:{k}s {W}><w:{k} w:id="-1"/><w:{k} w:id="0"/><w:{k} w:id="1"><w:p>{run(f"A short {k}.")}</w:p></w:{k}></w:{k}s>' for k in ("footnote", "endnote")}
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rIdLink" Type="hyperlink" Target="https://example.com/" TargetMode="External"/><Relationship Id="rIdImage" Type="image" Target="media/image1.png"/><Relationship Id="rIdNotes" Type="footnotes" Target="footnotes.xml"/></Relationships>'
    parts = {"[Content_Types].xml": "<Types/>", "word/document.xml": document, "word/_rels/document.xml.rels": rels, "word/media/image1.png": png([[0]])} | notes | more
    if style_sheet:
        parts["word/styles.xml"] = style_sheet
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def manuscript(wrong: bool = False, columns: int = 2) -> bytes:
    return package(body(wrong, columns), styles(wrong))


def png(gray: list[list[int]], kinds: list[int] | None = None) -> bytes:
    """An 8-bit grey PNG whose lines carry the given filters."""
    width, lines, before = len(gray[0]), b"", [0] * len(gray[0])
    for y, line in enumerate(gray):
        kind = kinds[y] if kinds else 0
        out = []
        for x, v in enumerate(line):
            a, b, c = line[x - 1] if x else 0, before[x], before[x - 1] if x else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda t: (abs(p - t), (a, b, c).index(t)))
            out.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        lines, before = lines + bytes([kind, *out]), line

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, len(gray), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
