"""keelsieve.operators"""
