"""Packages as bytes: the same members always give the same file, and documents from paragraphs and tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Mapping
from xml.sax.saxutils import escape

from docweft.sources.packages import MAIN_PARTS

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_EPOCH = (1980, 1, 1, 0, 0, 0)


def canonical_zip(members: Mapping[str, bytes]) -> bytes:
    """A package of sorted members with one fixed time, so that equal contents are equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name in sorted(members):
            info = zipfile.ZipInfo(name, _EPOCH)
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o600 << 16
            package.writestr(info, members[name])
    return out.getvalue()


def repacked(data: bytes) -> bytes:
    """The canonical form of a package."""
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        return canonical_zip({i.filename: package.read(i) for i in package.infolist() if not i.is_dir()})


def _paragraph(text: str) -> str:
    kept = "".join(c for c in text if c in "\t\n" or (" " <= c <= "\ud7ff") or "\ue000" <= c <= "\ufffd" or c > "\uffff")
    return f'<w:p><w:r><w:t xml:space="preserve">{escape(kept)}</w:t></w:r></w:p>'


def _table(rows: list[list[str]]) -> str:
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"


def office_members(form: str, blocks: list[str | list[list[str]]]) -> dict[str, bytes]:
    """The members of a DOCX (paragraphs and tables) or PPTX (a slide for each text) package."""
    main = next(part[1:] for part, (kind, _) in MAIN_PARTS.items() if kind == form)
    members = {
        "[Content_Types].xml": f'<Types><Override PartName="/{main}" ContentType="{MAIN_PARTS["/" + main][1]}"/></Types>',
        "_rels/.rels": f'<Relationships><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="{main}"/></Relationships>',
    }
    if form == "docx":
        members[main] = f'<w:document xmlns:w="{_W}"><w:body>{"".join(_paragraph(b) if isinstance(b, str) else _table(b) for b in blocks)}</w:body></w:document>'
    else:
        names = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        members[main] = f'<p:presentation {names}><p:sldIdLst>{"".join(f"""<p:sldId id="{256 + n}" r:id="rId{n}"/>""" for n in range(1, len(blocks) + 1))}</p:sldIdLst></p:presentation>'
        members["ppt/_rels/presentation.xml.rels"] = f'<Relationships>{"".join(f"""<Relationship Id="rId{n}" Type="x/slide" Target="slides/slide{n}.xml"/>""" for n in range(1, len(blocks) + 1))}</Relationships>'
        for n, text in enumerate(blocks, 1):
            members[f"ppt/slides/slide{n}.xml"] = f"<p:sld {names}><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>{escape(str(text))}</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>"
    return {name: text.encode() for name, text in members.items()}


def pdf_bytes(pages: list[list[str]]) -> bytes:
    """A PDF of pages of lines in Latin-1, each line one text operator."""
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{4 + 2 * n} 0 R' for n in range(len(pages)))}] /Count {len(pages)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for n, lines in enumerate(pages):
        shown = " ".join("({}) Tj T*".format("".join("\\" + c if c in "()\\" else c for c in line)) for line in lines)
        stream = f"BT /F1 10 Tf 12 TL 50 780 Td {shown} ET"
        objects += [f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * n} 0 R >>", f"<< /Length {len(stream.encode('latin-1', 'replace'))} >>\nstream\n{stream}\nendstream"]
    out, offsets = b"%PDF-1.4\n", []
    for n, body in enumerate(objects, 1):
        offsets.append(len(out))
        out += f"{n} 0 obj\n".encode() + body.encode("latin-1", "replace") + b"\nendobj\n"
    table = "".join(f"{at:010d} 00000 n \n" for at in offsets)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()
