"""How the star schema's tables play the parts of trips, legs, stays and items."""
