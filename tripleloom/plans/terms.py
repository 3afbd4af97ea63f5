"""Terms: validation, prefixes and vocabulary.  Everything here is driver-side and small."""

from __future__ import annotations

import re

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
SH = "http://www.w3.org/ns/shacl#"

TYPE = RDF + "type"
LABEL, COMMENT = RDFS + "label", RDFS + "comment"
SUBCLASS, DOMAIN, RANGE = RDFS + "subClassOf", RDFS + "domain", RDFS + "range"
INVERSE, SAME = OWL + "inverseOf", OWL + "sameAs"
DEFINITION, PREF = SKOS + "definition", SKOS + "prefLabel"
TRANSITIVE, FUNCTIONAL = OWL + "TransitiveProperty", OWL + "FunctionalProperty"
CLASSES = (OWL + "Class", RDFS + "Class")
PROPERTIES = (OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "AnnotationProperty")
TEXT_PROPERTIES = (LABEL, COMMENT, PREF, DEFINITION)

#: Types that belong to the vocabulary and never name an instance's class.
VOCABULARY_TYPES = (
    *CLASSES, *PROPERTIES, RDF + "Property", TRANSITIVE, FUNCTIONAL, OWL + "SymmetricProperty", OWL + "InverseFunctionalProperty",
    OWL + "AsymmetricProperty", OWL + "ReflexiveProperty", OWL + "IrreflexiveProperty",
    OWL + "Ontology", OWL + "NamedIndividual", OWL + "Restriction", RDFS + "Datatype",
)
NUMERIC = tuple(XSD + t for t in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong"))
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "skos": SKOS, "sh": SH}

_ONTOLOGY = re.compile(r"[A-Za-z0-9_-]+")
_IRI = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`\x00-\x20]+")
_CURIE = re.compile(r"([A-Za-z_][\w.-]*|):([\w%./-]*)")
_VARIABLE = re.compile(r"\?[A-Za-z_]\w*")


def ontology_id(name: str | None) -> str | None:
    """A checked ontology id; None stays (union for reads, the default graph for writes)."""
    if name is not None and not _ONTOLOGY.fullmatch(name):
        raise ValueError(f"not an ontology id: {name!r}")
    return name


# The least and most that a caller may ask for.
LIMITS = {"search": (1, 200), "similar": (1, 100), "depth": (1, 6), "related": (1, 1000), "pattern": (1, 10_000)}


def limit(what: str, value: int) -> int:
    """A checked limit; ValueError outside of ``LIMITS``."""
    least, most = LIMITS[what]
    if not least <= value <= most:
        raise ValueError(f"{what} must be {least} to {most}, not {value}")
    return value


def is_variable(term: str) -> bool:
    return bool(_VARIABLE.fullmatch(term))


def iri(term: str, prefixes: dict[str, str] | None = None) -> str:
    """An absolute IRI from ``<iri>``, ``iri`` or ``prefix:local``; ValueError for anything else."""
    if not isinstance(term, str):
        raise ValueError(f"not a term: {term!r}")
    if term.startswith("<") and term.endswith(">"):
        term = term[1:-1]
        prefixes = {}
    known = PREFIXES | (prefixes or {})
    m = _CURIE.fullmatch(term)
    if m and m[1] in known and (prefixes is not None or m[1] in PREFIXES):
        return known[m[1]] + m[2]
    if not _IRI.fullmatch(term):
        raise ValueError(f"not an IRI: {term!r}")
    return term


def shorten(full: str, prefixes: dict[str, str]) -> str:
    """``prefix__local`` by the longest namespace that fits, or the IRI itself."""
    fits = [(len(ns), p, ns) for p, ns in prefixes.items() if full.startswith(ns)]
    if not fits:
        return full
    _, p, ns = max(fits)
    return f"{p}__{full[len(ns):]}"


def expand(short: str, prefixes: dict[str, str]) -> str:
    p, sep, local = short.partition("__")
    return prefixes[p] + local if sep and p in prefixes else short


def name_prefixes(namespaces: list[str], known: dict[str, str]) -> dict[str, str]:
    """``known`` and an ``nsN`` for every namespace without a prefix, numbered in sorted order."""
    out, n = dict(known), 0
    for ns in sorted(set(namespaces) - set(known.values())):
        while f"ns{n}" in out:
            n += 1
        out[f"ns{n}"] = ns
    return out
