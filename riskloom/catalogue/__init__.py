"""Every registered query of the library proper, and its SQL."""

from riskloom.catalogue import checks, packages, projects, texts

QUERIES = {**texts.QUERIES, **packages.QUERIES, **projects.QUERIES, **checks.QUERIES}
ORACLES = {**texts.ORACLES, **packages.ORACLES, **projects.ORACLES, **checks.ORACLES}
