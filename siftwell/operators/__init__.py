"""Single operators over cells, profiles, losses and cutoffs."""
