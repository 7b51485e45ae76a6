"""Options of the reductions: names, types and defaults; INI files and command lines; unknown names are errors."""

from __future__ import annotations

import configparser
from typing import Any

LIST, WORDS = "list", "words"

# The option names, their types and defaults are the interface that users' files are written for.
COMMON: dict[str, tuple[Any, Any]] = {
    "input.directory": (str, ""), "input.prefix": (str, ""), "input.extension": (str, ".fits"), "input.fileList": (str, ""), "input.deleteFront": (int, 0), "input.deleteBack": (int, 0),
    "input.qualityFile": (str, ""), "input.qualityThreshold": (float, 0.0), "input.thresholdOnly": (bool, False), "input.dateKeyword": (str, "DATE-OBS"), "input.dateIsISO8601": (bool, True),
    "input.dateUnit": (float, 1.0), "input.imSize": (int, 0), "input.maskFile": (str, ""), "input.angleKeyword": (str, ""), "input.angleScale": (float, 1.0), "input.angleConstant": (float, 0.0),
    "rdi.directory": (str, ""), "rdi.prefix": (str, ""), "rdi.extension": (str, ".fits"), "rdi.fileList": (str, ""), "rdi.deleteFront": (int, 0), "rdi.deleteBack": (int, 0), "rdi.qualityFile": (str, ""),
    "rdi.qualityThreshold": (float, 0.0), "rdi.dateKeyword": (str, "DATE-OBS"), "rdi.dateIsISO8601": (bool, True), "rdi.dateUnit": (float, 1.0), "rdi.maskFile": (str, ""), "rdi.useInputMask": (bool, False),
    "coadd.method": (str, "none"), "coadd.maxImno": (int, 0), "coadd.maxTime": (float, 0.0), "coadd.maxAngle": (float, 0.0), "coadd.keywords": (WORDS, []),
    "preProcess.skip": (bool, False), "preProcess.beforeCoadd": (bool, False), "preProcess.mask": (bool, True), "preProcess.subradprof": (bool, False), "preProcess.azUSM_azHalfWidth": (float, 0.0),
    "preProcess.azUSM_azW": (float, 0.0), "preProcess.azUSM_maxAz": (float, 45.0), "preProcess.azUSM_radHalfWidth": (float, 0.0), "preProcess.azUSM_radW": (float, 0.0), "preProcess.medianUSM_fwhm": (int, 0),
    "preProcess.gaussUSM_fwhm": (float, 0.0), "preProcess.meanSubMethod": (str, "none"), "preProcess.pixelTSNormMethod": (str, "none"), "preProcess.pixelTSSigma": (float, 3.0), "preProcess.outputPrefix": (str, ""),
    "preProcess.only": (bool, False), "adi.postMedSub": (bool, False), "fake.method": (str, "single"), "fake.fileName": (str, ""), "fake.scaleFileName": (str, ""), "fake.sep": (LIST, []), "fake.PA": (LIST, []),
    "fake.contrast": (LIST, []), "fake.RDIFluxScale": (LIST, []), "fake.RDISepScale": (LIST, []), "combine.method": (str, "mean"), "combine.weightFile": (str, ""), "combine.sigmaThreshold": (float, 0.0),
    "combine.minGoodFract": (float, 0.0), "combine.noDerotate": (bool, False), "output.fileName": (str, "finim_"), "output.exactFName": (bool, False), "output.directory": (str, ""), "output.outputPSFSub": (bool, False),
    "output.psfSubPrefix": (str, ""), "mode": (str, "basic"), "showTiming": (bool, False),
}
PRINCIPAL: dict[str, tuple[Any, Any]] = {
    "postprocess.directory": (str, ""), "postprocess.prefix": (str, ""), "postprocess.extension": (str, ".fits"), "geom.minRadius": (LIST, []), "geom.maxRadius": (LIST, []), "geom.minAngle": (LIST, []),
    "geom.maxAngle": (LIST, []), "geom.nWedges": (int, 0), "klip.meanSubMethod": (str, "imageMean"), "klip.pixelTSNormMethod": (str, "none"), "klip.pixelTSSigma": (float, 3.0), "klip.includeRefNum": (int, 0),
    "klip.includeMethod": (str, "all"), "klip.Nmodes": (LIST, []), "klip.rightReason": (bool, False), "klip.rrRadius": (float, 2.5), "klip.writeDiagnostics": (bool, False), "klip.diagnosticDirectory": (str, "."),
    "adi.minDPx": (float, 0.0), "adi.maxDPx": (float, 0.0), "adi.excludeMethod": (str, "none"), "adi.excludeMethodMax": (str, "none"),
}
PIXEL: dict[str, tuple[Any, Any]] = {
    "geom.minRadius": (LIST, []), "geom.maxRadius": (LIST, []), "p4.regressionFrame": (str, "detector"), "p4.numberImages": (int, 0), "p4.modeFractions": (LIST, []), "p4.orDeltaRadiusInner": (float, 0.0),
    "p4.orDeltaRadiusOuter": (float, 0.0), "p4.orArcHalfWidth": (float, 0.0), "p4.orMaxHalfAngle": (float, 180.0), "p4.psfRadius": (float, 0.0), "p4.exclusionPolicy": (str, "sampleCenter"),
    "p4.exclusionRadiusBuffer": (float, 0.0), "p4.rankTolerance": (float, 1e-12), "p4.memoryFraction": (float, 0.8), "p4.localStampSize": (int, 0), "p4.psfFile": (str, ""), "p4.psfStampSize": (int, 0),
    "p4.outputPSFModels": (bool, False), "p4.psfFilter": (bool, False), "p4.psfFilterMinGoodFract": (float, 0.0), "p4.psfOutputPrefix": (str, ""), "p4.writeDiagnostics": (bool, False), "p4.diagnosticDirectory": (str, "."),
    "p4Optimize.enabled": (bool, False), "p4Optimize.modeFraction": (float, 0.0), "p4Optimize.apertureRadius": (float, 0.0), "p4Optimize.fitPosition": (bool, False), "p4Optimize.contrastLower": (float, 0.0),
    "p4Optimize.contrastUpper": (float, 0.0), "p4Optimize.maxEvaluations": (int, 64), "p4Optimize.validationSamples": (int, 9), "p4Optimize.parameterTolerance": (float, 1e-4), "p4Optimize.positionTolerance": (float, 1e-3),
    "p4Optimize.meritTolerance": (float, 1e-9), "p4Optimize.positionBound": (float, 1.0), "p4Optimize.uncertaintyBlocks": (int, 0), "p4Optimize.outputPrefix": (str, ""),
}
ANALYSIS: dict[str, tuple[Any, Any]] = {
    "file": (str, ""), "planet.sep": (LIST, []), "planet.PA": (LIST, []), "planet.R": (LIST, []), "fake.sep": (LIST, []), "fake.PA": (LIST, []), "fake.contrast": (LIST, []), "fake.R": (LIST, []), "snr.minRad": (float, 0.0),
    "snr.maxRad": (float, 0.0), "snr.apertureR": (float, 1.0), "filter.hpfGaussFW": (float, 0.0), "filter.lpfGaussFW": (float, 0.0), "diagnostics": (bool, False),
}
CHOICES = {
    "coadd.method": ("none", "median", "mean"), "preProcess.meanSubMethod": ("none", "meanImage", "medianImage"), "preProcess.pixelTSNormMethod": ("none", "rms"), "fake.method": ("single", "list"),
    "combine.method": ("none", "mean", "median", "weighted", "sigmaMean"), "klip.meanSubMethod": ("none", "imageMean", "imageMedian", "meanImage", "medianImage"), "klip.pixelTSNormMethod": ("none", "rms"),
    "klip.includeMethod": ("all", "corr", "time", "angle", "imno"), "adi.excludeMethod": ("none", "pixel", "angle", "imno"), "adi.excludeMethodMax": ("none", "pixel", "angle", "imno"),
    "p4.exclusionPolicy": ("sampleCenter", "kernelSupport"), "p4.regressionFrame": ("detector", "rotated"),
}
SCHEMAS = {"principal": COMMON | PRINCIPAL, "pixel": COMMON | PIXEL, "analysis": ANALYSIS}


def _convert(kind, text: str, name: str):
    try:
        if kind is bool:
            return {"true": True, "false": False}[text.strip().lower()]
        if kind == LIST:
            return [float(x) for x in text.split(",") if x.strip()]
        if kind == WORDS:
            return [x.strip() for x in text.split(",") if x.strip()]
        return kind(text.strip())
    except (KeyError, ValueError):
        raise ValueError(f"{name} can't be {text!r}") from None


def load(kind: str, path: str | None = None, arguments: list[str] | None = None) -> dict[str, Any]:
    """Options of a reduction: defaults, then the file, then ``--section.key value`` arguments."""
    schema = SCHEMAS[kind]
    given: dict[str, str] = {}
    if path:
        parser = configparser.ConfigParser(interpolation=None, comment_prefixes=("#",), inline_comment_prefixes=("#",))
        parser.optionxform = str
        with open(path) as f:
            parser.read_string("[__top]\n" + f.read())
        for section in parser.sections():
            for key, value in parser.items(section):
                given[key if section == "__top" else f"{section}.{key}"] = value
    rest = list(arguments or [])
    while rest:
        name = rest.pop(0)
        if not name.startswith("--"):
            raise ValueError(f"stray argument {name}")
        name, eq, value = name[2:].partition("=")
        given[name] = value if eq else (rest.pop(0) if rest else "")
    if unknown := sorted(set(given) - set(schema)):
        raise ValueError(f"unknown options: {', '.join(unknown)}")
    out = {k: (list(d) if isinstance(d, list) else d) for k, (_, d) in schema.items()}
    out |= {k: _convert(schema[k][0], v, k) for k, v in given.items()}
    for name, allowed in CHOICES.items():
        if name in out and out[name] not in allowed:
            raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    check(kind, out)
    return out


def check(kind: str, o: dict[str, Any]) -> None:
    """Rules that hold between options."""
    if kind == "analysis":
        if o["planet.sep"] and o["fake.sep"]:
            raise ValueError("planet and fake signals can't be mixed")
        for group in ("planet", "fake"):
            if len({len(o[f"{group}.sep"]), len(o[f"{group}.PA"])}) > 1:
                raise ValueError(f"{group}.sep and {group}.PA must match")
        return
    if len({len(o["fake.sep"]), len(o["fake.PA"]), len(o["fake.contrast"])}) > 1:
        raise ValueError("fake.sep, fake.PA and fake.contrast must match")
    if not 0 <= o["combine.minGoodFract"] <= 1:
        raise ValueError("combine.minGoodFract must be in [0, 1]")
    if o["combine.method"] == "weighted" and not o["combine.weightFile"]:
        raise ValueError("weighted combination needs combine.weightFile")
    if o["preProcess.only"] or o["mode"] == "postprocess":
        return
    lo, hi = o["geom.minRadius"], o["geom.maxRadius"]
    if len(lo) != len(hi):
        raise ValueError("geom.minRadius and geom.maxRadius must match")
    if kind == "pixel":
        if any(o[k] for k in ("rdi.directory", "rdi.prefix", "rdi.fileList")):
            raise ValueError("a pixel regression takes no reference library")
        f = o["p4.modeFractions"]
        if any(not 0 < x <= 1 for x in f) or any(b <= a for a, b in zip(f, f[1:], strict=False)):
            raise ValueError("p4.modeFractions must increase within (0, 1]")
        if any(b > c for b, c in zip(hi, lo[1:], strict=False)):
            raise ValueError("annuli must not overlap")
        if not 0 <= o["p4.rankTolerance"] < 1 or not 0 <= o["p4.memoryFraction"] <= 1:
            raise ValueError("p4.rankTolerance must be in [0, 1), p4.memoryFraction in [0, 1]")
        if o["p4.psfFilter"] and o["p4.psfStampSize"] % 2 == 0:
            raise ValueError("the PSF filter needs an odd stamp")
    elif any(x <= 0 or x != int(x) for x in o["klip.Nmodes"]):
        raise ValueError("klip.Nmodes must be positive integers")
