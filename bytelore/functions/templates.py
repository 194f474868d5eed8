"""Result lines by templates such as `OK,%(info.time)s,"%(info.filename)s"`, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default lines.
MATCH = 'OK,%(info.time)s,%(info.puid)s,"%(info.formatname)s","%(info.signaturename)s",%(info.filesize)s,"%(info.filename)s","%(info.mimetype)s","%(info.matchtype)s"\n'
NO_MATCH = 'KO,%(info.time)s,,,,%(info.filesize)s,"%(info.filename)s",,"%(info.matchtype)s"\n'

#: Field of a template -> column of the results.
FIELDS = {
    "info.time": "time_ms", "info.puid": "puid", "info.formatname": "formatname", "info.signaturename": "signaturename", "info.filesize": "filesize", "info.filename": "filename",
    "info.mimetype": "mimetype", "info.matchtype": "matchtype", "info.version": "version", "info.alias": "alias", "info.apple_uti": "apple_uti", "info.group_size": "group_size",
    "info.group_index": "group_index", "info.count": "count",
}
#: Fields of lines without a match.
FIELDS_NO_MATCH = ("info.time", "info.filesize", "info.filename", "info.matchtype", "info.count")

_SLOT = re.compile(r"%(?:\((?P<name>[^)]*)\)(?P<flags>[-0 +#]*)(?P<width>\d*)(?:\.(?P<cut>\d+))?(?P<kind>[sdi])|%)")


def unescaped(template: str) -> str:
    """Written-out `\\n` and `\\t` as a line feed and a tab."""
    return template.replace("\\n", "\n").replace("\\t", "\t")


def parts(template: str) -> list[tuple[str, re.Match | None]]:
    """(text, slot behind it) of a template."""
    out, at = [], 0
    text = ""
    for m in _SLOT.finditer(template):
        text += template[at : m.start()]
        at = m.end()
        if m["name"] is None:
            text += "%"
        else:
            out.append((text, m))
            text = ""
    text += template[at:]
    if "%" in re.sub(_SLOT, "", template):
        raise ValueError(f"not a template: {template!r}")
    return [*out, (text, None)]


def line(template: str, fields: dict[str, str] | None = None) -> Column:
    """The line of a row; a missing value is written as `None`."""
    fields, columns = fields or FIELDS, []
    for text, slot in parts(template):
        if text:
            columns.append(F.lit(text))
        if slot:
            if slot["name"] not in fields:
                raise KeyError(slot["name"])
            value = F.coalesce(F.col(fields[slot["name"]]).cast("string"), F.lit("None"))
            if slot["cut"] and slot["kind"] == "s":
                value = F.substring(value, 1, int(slot["cut"]))
            if slot["width"]:
                width, filler = int(slot["width"]), "0" if "0" in slot["flags"] and slot["kind"] != "s" and "-" not in slot["flags"] else " "
                padded = F.rpad(value, width, " ") if "-" in slot["flags"] else F.lpad(value, width, filler)
                value = F.when(F.length(value) < width, padded).otherwise(value)
            columns.append(value)
    return F.concat(*columns) if columns else F.lit("")
