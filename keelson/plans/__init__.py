"""Query plans: reading, hinting, rewriting and comparing them."""
