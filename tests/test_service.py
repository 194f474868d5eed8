import pytest

from bytelore.sources import service

ANSWER = b"""<s:Envelope xmlns:s="http://schemas.xmlsoap.org/soap/envelope/"><s:Body><r xmlns="http://pronom.nationalarchives.gov.uk"><Version><Version>120</Version></Version></r></s:Body></s:Envelope>"""
FILE = b"""<FFSignatureFile xmlns="http://www.nationalarchives.gov.uk/pronom/SignatureFile"><FileFormat PUID="fmt/1"/><FileFormat PUID="fmt/2"/></FFSignatureFile>"""


def test_service():
    asked = []

    def send(url, body, headers):
        asked.append((url, body, headers))
        return (200, ANSWER) if body else (200, FILE) if "DROID" in url else (404, b"")

    client = service.RegistryService(send)
    assert client.version() == 120 and client.signature_file(120) == (FILE, 2)
    assert b"getSignatureFileVersionV1" in asked[0][1] and asked[0][2]["SOAPAction"] == '"http://pronom.nationalarchives.gov.uk:getSignatureFileVersionV1In"'
    with pytest.raises(LookupError):
        client.record("fmt/1")
