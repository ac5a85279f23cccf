"""Training-data operators: each module holds one operator, its thin registered query and its SQL twin."""
