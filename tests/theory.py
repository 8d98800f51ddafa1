"""Spectra made from theory, and writers of spectrum files, for tests."""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np

from massq.functions.chem import PROTON, RESIDUES, WATER


def mass(peptide):
    return sum(RESIDUES[c] for c in peptide) + WATER


def mz(peptide, charge):
    return (mass(peptide) + charge * PROTON) / charge


def fragments(peptide, charge=1):
    m = np.array([RESIDUES[c] for c in peptide])
    b, y = np.cumsum(m)[:-1], np.cumsum(m[::-1])[:-1] + WATER
    return sorted([float(x + z * PROTON) / z for x in (*b, *y) for z in range(1, charge + 1)])


def spectrum(run, scan, peptide, charge=2, level=2, keep=1.0, seed=0, rt=None, window=1.0):
    rng = np.random.default_rng(seed + scan)
    peaks = [p for p in fragments(peptide) if rng.random() < keep]
    noise = rng.uniform(150, 1200, 5).tolist()
    mzs = sorted(peaks + noise)
    one = {"mz": mz(peptide, charge), "charge": charge, "intensity": 10.0, "isolation": {"target": mz(peptide, charge), "lower": window, "upper": window}, "source_scan": None}
    return (run, scan, level, float(scan if rt is None else rt), [one] if level == 2 else [], mzs, [100.0 if p in peaks else 5.0 for p in mzs], "centroid")


def mgf(rows, close=True):
    out = []
    for r in rows:
        p = r[4][0]
        out.append(f"BEGIN IONS\nTITLE=t{r[1]}\nPEPMASS={p['mz']!r} {p['intensity']}\nCHARGE={p['charge']}+\nRTINSECONDS={r[3] * 60!r}\nSCANS={r[1]}\n" + "\n".join(f"{a!r} {b!r}" for a, b in zip(r[5], r[6])) + ("\nEND IONS\n" if close else "\n"))
    return "".join(out)


def _binary(values, kind, packed):
    raw = np.array(values, kind).tobytes()
    return base64.b64encode(zlib.compress(raw) if packed else raw).decode()


def mzml(rows, kind="<f8", packed=True):
    out = ['<?xml version="1.0"?><mzML><run><spectrumList>']
    size = "MS:1000523" if kind == "<f8" else "MS:1000521"
    for k, r in enumerate(rows):
        out.append(f'<spectrum index="{k}" id="controllerType=0 scan={r[1]}"><cvParam accession="MS:1000511" value="{r[2]}"/><scanList><scan><cvParam accession="MS:1000016" value="{r[3] * 60!r}" unitAccession="UO:0000010"/></scan></scanList>')
        for p in r[4]:
            w = p["isolation"]
            out.append(f'<precursorList><precursor spectrumRef="scan={p["source_scan"] or 1}"><isolationWindow><cvParam accession="MS:1000827" value="{w["target"]!r}"/><cvParam accession="MS:1000828" value="{w["lower"]!r}"/><cvParam accession="MS:1000829" value="{w["upper"]!r}"/></isolationWindow><selectedIonList><selectedIon><cvParam accession="MS:1000744" value="{p["mz"]!r}"/><cvParam accession="MS:1000041" value="{p["charge"]}"/></selectedIon></selectedIonList></precursor></precursorList>')
        for accession, values in (("MS:1000514", r[5]), ("MS:1000515", r[6])):
            out.append(f'<binaryDataArray><cvParam accession="{size}"/><cvParam accession="{"MS:1000574" if packed else "MS:1000576"}"/><cvParam accession="{accession}"/><binary>{_binary(values, kind, packed)}</binary></binaryDataArray>')
        out.append("</spectrum>\n")
    return "".join(out) + "</spectrumList></run></mzML>"


def pfb(rows):
    body, at = b"", []
    for r in rows:
        fields = [str(r[1]), str(r[2]), repr(r[3] * 60), "FTMS"]
        if r[4]:
            p = r[4][0]
            fields += [str(p["charge"]), "0", "0", repr(p["isolation"]["target"]), "HCD", "1", repr(2 * p["isolation"]["lower"]), "27", repr(p["mz"])]
        text = "\t".join(fields).encode()
        at.append(24 + len(body))
        body += struct.pack("<i", len(text)) + text + struct.pack("<i", len(r[5])) + np.array(r[5], "<f8").tobytes() + np.array(r[6], "<f8").tobytes()
    return struct.pack("<iiiqi", 0, 0, 0, 24 + len(body), len(rows)) + body + struct.pack(f"<{len(at)}q", *at)
