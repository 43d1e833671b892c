"""Reading events, rules and cases, and writing them."""
