"""Readers: scraper files, feeds, sitemaps, pages, gazetteers, evaluation sets."""
