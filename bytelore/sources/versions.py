"""Versions of registries: the local record, and updates by an interchangeable client."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, fields
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelore.functions.names import record_file, version_column, version_number

#: Attribute -> element of the version file.
ELEMENTS = {
    "pronom_version": "pronomVersion",
    "pronom_signature": "pronomSignature",
    "pronom_container_signature": "pronomContainerSignature",
    "extension_signature": "extensionSignature",
    "update_script": "updateScript",
    "update_site": "updateSite",
}


@dataclass
class Versions:
    pronom_version: str | None = None
    pronom_signature: str | None = None
    pronom_container_signature: str | None = None
    extension_signature: str | None = None
    update_script: str | None = None
    update_site: str | None = None

    @classmethod
    def read(cls, path: str) -> Versions:
        """A missing or damaged file has no versions."""
        try:
            root = ElementTree.parse(path).getroot()
        except (OSError, ElementTree.ParseError):
            return cls()
        texts = {e.tag: e.text for e in root}
        own = next((t for t in texts if t.lower().endswith("extensionsignature")), None)  # whichever program's name is before it
        return cls(**{a: texts.get(own if a == "extension_signature" else e) for a, e in ELEMENTS.items()})

    def write(self, path: str) -> None:
        missing = [f.name for f in fields(self) if not getattr(self, f.name)]
        if missing:
            raise ValueError(f"no value for {', '.join(missing)}")
        root = ElementTree.Element("versions")
        for a, e in ELEMENTS.items():
            ElementTree.SubElement(root, e).text = getattr(self, a)
        ElementTree.indent(root, "\t")
        ElementTree.ElementTree(root).write(path, encoding="utf-8", xml_declaration=True)


Fetch = Callable[[str], tuple[int, bytes]]


@dataclass
class UpdateSite:
    """The update service; `fetch(url)` gives a status and a body, so that tests need no network."""

    site: str
    fetch: Fetch
    kinds: tuple[str, str, str] = ("formats", "droid", "pronom")  # path elements of the three files

    def versions(self) -> list[str]:
        _, body = self.fetch(f"{self.site}/format/")
        return [s.get("version") for s in ElementTree.fromstring(body).iter("signature")]

    def latest(self) -> str:
        _, body = self.fetch(f"{self.site}/format/latest/")
        root = ElementTree.fromstring(body)
        node = root if root.get("version") else next(root.iter("signature"))
        return node.get("version")

    def newer(self, local: Versions) -> str | None:
        latest = self.latest()
        return latest if version_number(latest) > (version_number(local.pronom_version or "0") or 0) else None

    def download(self, version: str, folder: str, local: Versions) -> Versions:
        """Fetches the three files of a version that are not there yet, and returns the new record."""
        number = version_number(version)
        if number is None:
            raise ValueError(f"not a version: {version}")
        base = f"{self.site}/format/v{number}"
        if self.fetch(f"{base}/")[0] != 200:
            raise LookupError(f"no version {number}")
        names = dict(zip(self.kinds, (f"formats-v{number}.xml", f"DROID_SignatureFile-v{number}.xml", f"pronom-xml-v{number}.zip"), strict=True))
        for kind, name in names.items():
            path = os.path.join(folder, name)
            if not os.path.exists(path):
                status, body = self.fetch(f"{base}/{kind}/")
                if status != 200:
                    raise LookupError(f"{kind} of version {number}: {status}")
                with open(path, "wb") as f:
                    f.write(body)
        values = {f.name: getattr(local, f.name) for f in fields(local)}
        return Versions(**values | {"pronom_version": str(number), "pronom_signature": names[self.kinds[0]]})


def act(action: str, local: Versions, client: UpdateSite, folder: str, say: Callable[[str], None] = print) -> Versions:
    """The actions `list`, `check`, `update` and a version number."""
    if action == "list":
        for v in client.versions():
            say(v)
    elif action == "check":
        new = client.newer(local)
        say(f"version {new} is available" if new else "the registry is up to date")
    elif action == "update":
        if new := client.newer(local):
            return client.download(new, folder, local)
        say("the registry is up to date")
    else:
        return client.download(action, folder, local)
    return local


#: Fixed value: the file of container signatures that an update names; it is not downloaded.
CONTAINER_FILE = "container-signature-UPDATE-ME.xml"


def updated(local: Versions, version: int) -> Versions:
    """The record after an update by the program itself: the site stays, the other files are named after the version."""
    from bytelore import __version__

    return Versions(str(version), f"formats-v{version}.xml", CONTAINER_FILE, local.extension_signature or "format_extensions.xml", __version__, local.update_site or "none")


def download_records(puids: list[str], fetch: Fetch, folder: str, progress: Callable[[int, int], None] = lambda done, all_: None, wait: Callable[[], None] = lambda: None) -> list[str]:
    """One record file for each puid that is not there yet; resumes an interrupted download."""
    out = []
    for k, puid in enumerate(puids, 1):
        path = os.path.join(folder, record_file(puid))
        if not os.path.exists(path):
            status, body = fetch(puid)
            if status == 200:
                with open(path, "wb") as f:
                    f.write(body)
            wait()
        if os.path.exists(path):
            out.append(path)
        progress(k, len(puids))
    return out


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """(key, n_versions, latest): the different versions of each key and the greatest; names that are no version are left out."""
    numbers = rows.select(key, version_column(version).alias("number")).where("number IS NOT NULL")
    return numbers.groupBy(key).agg(F.countDistinct("number").alias("n_versions"), F.max("number").alias("latest"))


def pack_records(paths: list[str], archive: str) -> None:
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in paths:
            z.write(p, os.path.basename(p))


def puids_of(signature_file: bytes) -> list[str]:
    """Puids of a signature file's formats."""
    return [e.get("PUID") for e in ElementTree.fromstring(signature_file).iter() if e.tag.endswith("FileFormat") and e.get("PUID")]
