"""Training-data operators: each module is one operator; ``queries`` and ``oracle`` register them."""
