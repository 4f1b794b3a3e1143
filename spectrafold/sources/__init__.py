"""Readers of instrument files, sample sheets and plate tables; the figure sink."""
