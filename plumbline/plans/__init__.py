"""From a recipe (plain data) to one lazy DataFrame plan, checked before anything runs."""
