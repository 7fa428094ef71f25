"""Multi-step jobs: model fits, walk-forward, search, stacking."""
