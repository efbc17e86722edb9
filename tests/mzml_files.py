"""Small mzML files made by rule, for the ingest tests."""

import base64
import struct
import zlib

TERMS = {
    "MS:1000511": "ms level",
    "MS:1000016": "scan start time",
    "MS:1002476": "ion mobility drift time",
    "MS:1000514": "m/z array",
    "MS:1000515": "intensity array",
    "MS:1000595": "time array",
    "MS:1000523": "64-bit float",
    "MS:1000521": "32-bit float",
    "MS:1000574": "zlib compression",
    "MS:1000576": "no compression",
}


def cv(accession, value=None, unit=None, name=None):
    name = name or TERMS.get(accession, accession)
    tail = (f' value="{value}"' if value is not None else "") + (f' unitAccession="{unit}"' if unit else "")
    return f'<cvParam cvRef="MS" accession="{accession}" name="{name}"{tail}/>'


def array(values, role, bits=64, zipped=True, unit=None, params=None):
    raw = struct.pack(f"<{len(values)}{'d' if bits == 64 else 'f'}", *values)
    text = base64.b64encode(zlib.compress(raw) if zipped else raw).decode()
    params = params or cv("MS:1000523" if bits == 64 else "MS:1000521") + cv("MS:1000574" if zipped else "MS:1000576")
    return f"<binaryDataArray>{params}{cv(role, '', unit)}<binary>{text}</binary></binaryDataArray>"


def spectrum(index, mz, intensity, level=1, rt=1.0, unit="UO:0000031", drift=None, precursor="", extra="", **kw):
    scan = cv("MS:1000016", rt, unit) + (cv("MS:1002476", drift) if drift is not None else "")
    level = "" if level is None else cv("MS:1000511", level)
    return (
        f'<spectrum index="{index}" id="scan={index + 1}" defaultArrayLength="{len(mz)}">{level}{extra}'
        f"<scanList count=\"1\"><scan>{scan}</scan></scanList>{precursor}<binaryDataArrayList count=\"2\">"
        f"{array(mz, 'MS:1000514', **kw)}{array(intensity, 'MS:1000515', **kw)}</binaryDataArrayList></spectrum>"
    )


def window(mz, lower=0.5, upper=0.5):
    terms = cv("MS:1000827", mz) + cv("MS:1000828", lower) + cv("MS:1000829", upper)
    return f"<isolationWindow>{terms}</isolationWindow>"


def precursor_list(mz, charge=0, intensity=0, ref=None):
    return f"<precursorList count=\"1\">{precursor(mz, charge, intensity, ref)}</precursorList>"


def precursor(mz, charge=0, intensity=0, ref=None):
    ref = f' spectrumRef="{ref}"' if ref else ""
    ion = cv("MS:1000744", mz) + cv("MS:1000041", charge) + cv("MS:1000042", intensity)
    return (
        f"<precursor{ref}>{window(mz)}<selectedIonList count=\"1\"><selectedIon>{ion}</selectedIon></selectedIonList>"
        f'<activation>{cv("MS:1000133", "", name="collision-induced dissociation")}{cv("MS:1000045", 35)}'
        f'<userParam name="note" type="xsd:string" value="x"/></activation></precursor>'
    )


def chromatogram(index, times, intensity, precursor_mz=None, product_mz=None, unit="UO:0000010", **kw):
    before = precursor(precursor_mz) if precursor_mz else ""
    after = f"<product>{window(product_mz, 0, 0)}</product>" if product_mz else ""
    return (
        f'<chromatogram index="{index}" id="chrom={index}" defaultArrayLength="{len(times)}">'
        f"{cv('MS:1000235', '', name='total ion current chromatogram')}{before}{after}"
        f"<binaryDataArrayList count=\"2\">{array(times, 'MS:1000595', unit=unit, **kw)}"
        f"{array(intensity, 'MS:1000515', **kw)}</binaryDataArrayList></chromatogram>"
    )


HEADER = (
    '<fileDescription><fileContent/><sourceFileList count="1">'
    '<sourceFile id="F1" name="a.raw" location="file:///data">'
    f'{cv("MS:1000768", "", name="Thermo nativeID format")}{cv("MS:1000563", "", name="Thermo RAW file")}'
    f'{cv("MS:1000569", "abc123", name="SHA-1")}</sourceFile></sourceFileList></fileDescription>'
    '<referenceableParamGroupList count="2"><referenceableParamGroup id="common">'
    f'{cv("MS:1001911", "", name="Q Exactive")}</referenceableParamGroup>'
    f'<referenceableParamGroup id="level2">{cv("MS:1000511", 2)}</referenceableParamGroup>'
    "</referenceableParamGroupList>"
    '<softwareList count="2"><software id="S1" version="2.2">'
    f'{cv("MS:1000532", "", name="Xcalibur")}</software><software id="S2" version="9">'
    f'{cv("MS:1000615", "", name="ProteoWizard")}</software></softwareList>'
    '<instrumentConfigurationList count="2"><instrumentConfiguration id="IC0"/><instrumentConfiguration id="IC1">'
    '<referenceableParamGroupRef ref="common"/><componentList count="3">'
    f'<source order="1">{cv("MS:1000073", "", name="electrospray ionization")}</source>'
    f'<analyzer order="2">{cv("MS:1000484", "", name="orbitrap")}</analyzer>'
    f'<detector order="3">{cv("MS:1000624", "", name="inductive detector")}</detector>'
    '</componentList><softwareRef ref="S1"/></instrumentConfiguration></instrumentConfigurationList>'
)


def run(spectra=(), chromatograms=(), header=HEADER):
    body = ""
    if spectra:
        body += f'<spectrumList count="99">{"".join(spectra)}</spectrumList>'
    if chromatograms:
        body += f'<chromatogramList count="99">{"".join(chromatograms)}</chromatogramList>'
    return (
        '<?xml version="1.0" encoding="ISO-8859-1"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml">'
        f'{header}<run id="r" defaultInstrumentConfigurationRef="IC1"><userParam name="lab" value="B\xe9"/>{body}</run></mzML>'
    )


def write(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode("iso-8859-1"))
    return str(path)
