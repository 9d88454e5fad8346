"""keelsieve.sources"""
