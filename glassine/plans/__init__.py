"""Changes as rows: catalogue versions, plans of moves, their journal, and the grammar that asks for them."""
