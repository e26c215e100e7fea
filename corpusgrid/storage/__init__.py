"""Tables in immutable segments that become visible together, and collections kept in them."""
