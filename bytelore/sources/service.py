"""Client of the public registry service: current version, signature files, single records.

`send(url, body, headers)` gives a status and the answer; tests put their own in its place, `over_http` uses the network.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib import error, request
from xml.etree import ElementTree

#: Addresses and namespaces of the service.
HOST = "www.nationalarchives.gov.uk"
SERVICE = f"http://{HOST}/pronom/service.asmx"
RECORDS = f"http://{HOST}/pronom/{{puid}}.xml"
SIGNATURES = f"https://{HOST}/documents/DROID_SignatureFile_V{{version}}.xml"
NAMESPACE = "http://pronom.nationalarchives.gov.uk"
ENVELOPE = "http://schemas.xmlsoap.org/soap/envelope/"
VERSION_ACTION = "getSignatureFileVersionV1"

Send = Callable[[str, bytes | None, dict[str, str]], tuple[int, bytes]]


def over_http(url: str, body: bytes | None = None, headers: dict[str, str] | None = None) -> tuple[int, bytes]:
    try:
        with request.urlopen(request.Request(url, data=body, headers=headers or {})) as answer:
            return answer.status, answer.read()
    except error.HTTPError as e:
        return e.code, b""


def question(action: str) -> tuple[bytes, dict[str, str]]:
    """Body and headers that ask the service for an action without arguments."""
    ElementTree.register_namespace("soap", ENVELOPE)
    root = ElementTree.Element(f"{{{ENVELOPE}}}Envelope")
    ElementTree.SubElement(ElementTree.SubElement(root, f"{{{ENVELOPE}}}Body"), f"{{{NAMESPACE}}}{action}")
    body = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
    return body, {"Content-type": 'text/xml; charset="UTF-8"', "SOAPAction": f'"{NAMESPACE}:{action}In"'}


@dataclass
class RegistryService:
    send: Send = over_http

    def _ask(self, url: str, body: bytes | None = None, headers: dict[str, str] | None = None) -> bytes:
        status, answer = self.send(url, body, headers or {})
        if status != 200:
            raise LookupError(f"{url}: {status}")
        return answer

    def version(self) -> int:
        """Number of the latest signature file."""
        answer = ElementTree.fromstring(self._ask(SERVICE, *question(VERSION_ACTION)))
        found = answer.find(f".//{{{NAMESPACE}}}Version/{{{NAMESPACE}}}Version")
        if found is None or not found.text:
            raise LookupError("the service names no version")
        return int(found.text)

    def signature_file(self, version: int) -> tuple[bytes, int]:
        """A signature file and the number of its formats."""
        xml = self._ask(SIGNATURES.format(version=version))
        return xml, sum(e.tag.endswith("}FileFormat") for e in ElementTree.fromstring(xml).iter())

    def record(self, puid: str) -> bytes:
        return self._ask(RECORDS.format(puid=puid))
