"""DataFrame operators: neighbours, hubs and groups, closure, fuzzy graph, layout, evaluation."""
