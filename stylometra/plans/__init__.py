"""Registered queries: importing this package fills the registry."""

from . import catalog, composites, gaussian, hierarchy, inference, linguistic, modelling, nested, relational, sampling, selection, variational  # noqa: F401
