"""DataFrame operators: graph, context, history, statistics, packing, views, extraction, export."""
