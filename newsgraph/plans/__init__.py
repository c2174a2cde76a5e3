"""All registered queries: whichever plan is imported first, they are loaded in this order, those that others build on first."""

from newsgraph.plans import model, monitoring, articles, alerts, extraction, feeds, graph, quality, reports, review, snapshots, series, similar, streams, text, vectors  # noqa: F401, I001
